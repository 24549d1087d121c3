"""Personal data by candidate gradient boosting.

Base spans come from four fixed patterns and always stay. Generators of high recall propose further,
overlapping spans: numbers in any grouping, addresses spelt with 'at' and 'dot', long keys. Boosted trees
score each proposal for each kind by its format and its context; a proposal is added if it reaches the
kind's threshold and overlaps no base span and no better proposal. Besides the base patterns' kinds the
trees know secrets (keys, tokens, passwords in an assignment).

There are no hand-made labels. The trees learn from generated records in many formats and from generated
decoys (dates, order numbers, digests, prose with 'at'), each put into text of a bounded sample of the
corpus; what else the corpus proposes is unlabelled and taken as neither. Thresholds are set on examples
that the trees did not see.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm import boosting
from guardlake.llm.records import ENDINGS, GROUPS, Maker, example, luhn
from guardlake.llm.shared import bounded_share, draw, map_text, named

KINDS = ("email", "ip", "card", "phone")
#: What the trees add to the kinds of the base patterns; it comes last where spans begin together.
ALL_KINDS = (*KINDS, "secret")
#: Texts that training takes as surroundings, about so many at most, of so many code points each.
SAMPLE_TEXTS, SAMPLE_POINTS = 2_000, 400
#: Generated examples of each group of kinds: records and decoys.
EXAMPLES = 2_000
PRECISION = 0.98
SEED = 37
CONTEXT = 24
#: Candidates whose features are computed together.
AT_ONCE = 8_192
BEYOND = 8

#: All base spans but emails lie inside such stretches.
_ZONE = re.compile(r"[+0-9][0-9 ().+-]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_HEX_SET = frozenset("0123456789abcdefABCDEF")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The generators. Each finds its anchors in one pass, and what it tries at an anchor is bounded.
_NUMBER_ZONE = re.compile(r"[0-9+(][0-9 ()./\[\]_dot+-]{5,}")
_NUMBERS = tuple(map(re.compile, (
    r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9A-Za-z])[0-9](?: ?[./_-]? ?[0-9]){12,18}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+(])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,2}[0-9]){5,14}(?![0-9A-Za-z])",
)))
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX_GROUPS = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){3,8}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_AT = re.compile(r"[@\[( ](?:(?<=@)|[aA][tT][\]) ])")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)|(?<= )at(?= )) ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|\[dot\]|\(dot\)|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,64}+){0,8}", re.I)
_KEYS = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}+")
_DIGIT = re.compile("[0-9]")
KEY_MOST = 512
_HINTS = {
    "email": ("mail", "contact", "write"), "ip": ("ip ", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "key", "passw", "auth", "bearer"), "other": ("order", "ref", "isbn", "no.", "item", "id=", "pp.", "rfc"), "digest": ("sha", "md5", "commit", "hash", "sum", "etag", "digest", "build"),
}
_HINT = re.compile("|".join("(" + "|".join(map(re.escape, words)) + ")" for words in _HINTS.values()))


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from the at signs outwards: linear in the text, whatever it holds."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' valid matches, leftmost and non-overlapping for each kind, by start and then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    for zone in _ZONE.finditer(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text, zone.start(), zone.end()) if valid(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """(start, end, group) of all candidate spans, a few for each place at most; they may overlap. Groups: 'n' numbers, 'm' mail, 's' secrets."""
    out = set()
    for zone in _NUMBER_ZONE.finditer(text):
        a, b = zone.span()
        for pattern in _NUMBERS:
            for m in pattern.finditer(text, a, b):
                out.add((m.start(), m.end(), "n"))
                first, last = text.find(" ", m.start(), m.end()), text.rfind(" ", m.start(), m.end())
                if first > 0:  # a number may stand before or after it
                    out.update((c, d, "n") for c, d in ((first + 1, m.end()), (m.start(), last)) if d - c >= 7)
    done = 0
    for colons in _COLONS.finditer(text):
        start = colons.start()
        while start > done and colons.start() - start < 4 and text[start - 1] in _HEX_SET:
            start -= 1
        if start >= done and not text[max(0, start - 1) : start].isalnum() and (m := _HEX_GROUPS.match(text, start)):
            out.add((start, m.end(), "n"))
            done = m.end()
    done = 0
    for at in _AT.finditer(text):
        start = at.start()
        if start < done:
            continue
        if text[start - 1 : start] == " " and at[0] != " ":
            start -= 1
        while start > done and at.start() - start < 65 and text[start - 1] in _LOCAL_SET:
            start -= 1
        if m := _SPELT.match(text, start):
            out.add((start, m.end(), "m"))
            cut = text.find(". ", at.end(), m.end())  # a domain may end with the sentence
            if cut > at.end():
                out.add((start, cut, "m"))
            done = at.end()
    for m in _KEYS.finditer(text):
        whole = m[0].rstrip(".=")
        if 16 <= len(whole) <= KEY_MOST and _DIGIT.search(whole):
            out.add((m.start(), m.start() + len(whole), "s"))
            equals = whole.find("=")
            if 0 < equals <= len(whole) - 16:  # name=value
                out.add((m.start() + equals + 1, m.start() + len(whole), "s"))
    return sorted(out)


#: Classes of code points that features count.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " ", ".", "-", "()", "+", "@", ":", "/", "_", "[]", "=", "\"'")
_CLASS = np.full(128, len(_CLASSES), np.int8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_OTHER = len(_CLASSES)


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """A row for each candidate (text, start, end): its format, and what stands around it. Linear in the candidates' total length."""
    n = len(found)
    starts, ends = [max(0, a - CONTEXT) for _, a, _ in found], [min(len(text), b + CONTEXT // 2) for text, _, b in found]
    joined = "".join([text[a:b] for (text, _, _), a, b in zip(found, starts, ends)])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(points < 128, _CLASS[np.minimum(points, 127)], _OTHER)
    size = np.array(ends) - np.array(starts)
    first = np.cumsum(size) - size
    s = first + np.array([a for _, a, _ in found]) - np.array(starts)
    e = s + np.array([b - a for _, a, b in found])
    upto = lambda hit: np.concatenate([[0], np.cumsum(hit)])
    counts = [(c := upto(kind == i))[e] - c[s] for i in range(_OTHER + 1)]
    digit = kind == 0
    begins = digit.copy()
    begins[1:] &= ~digit[:-1]
    groups = (c := upto(begins))[e] - c[s]
    at = np.arange(len(points))
    run = at - np.maximum.accumulate(np.where(digit, -1, at)) if len(points) else at
    longest = np.maximum.reduceat(np.append(np.where(digit, run, 0), 0), np.stack([s, e], 1).ravel())[::2]
    # Luhn: each digit's place from the right inside its own candidate
    own = np.repeat(np.arange(n), size)
    inside = digit & (at >= s[own]) & (at < e[own])
    seen = upto(digit)
    place = seen[e][own] - seen[1:][at]
    value = np.where(inside, points.astype(np.int64) - 48, 0) * (1 + place % 2)
    total = np.bincount(own, value - 9 * (value > 9), n)
    before = np.where(s > first, kind[np.maximum(s - 1, 0)], -1)
    after = np.where(e < first + size, kind[np.minimum(e, len(kind) - 1)], -1)
    length = e - s
    columns = [*counts, length, groups, longest, counts[0] / length, (total % 10 == 0) & (counts[0] > 0), before, after, before == 16, after == 16]
    rows = []
    for (text, a, b), lo, hi in zip(found, starts, ends):
        span, near = text[a:b], (text[lo:a] + " " + text[b:hi]).lower()
        low = span.lower() if len(span) <= 120 else ""
        lead = text[max(0, a - 4) : a]
        hints = [0] * len(_HINTS)
        for m in _HINT.finditer(near):
            hints[m.lastindex - 1] = 1
        rows.append((
            len(set(span)) / len(span), span[0] in "+(", span[:2] == "00", span[0] == "0", low.count(" at ") + low.count(" dot "), low.count("dot"), span.count(". "), "::" in span,
            "=" in lead, ":" in lead, bool(_DIGIT.search(lead[-2:])), ")" in lead[-2:], bool(_DIGIT.search(text[b : b + 2])), low.rsplit("dot", 1)[-1].strip(" .])[(").rsplit(".", 1)[-1] in _LAST if low else False, _octets(span) if span.count(".") + span.count("dot") == 3 and b - a < 48 else -1,
            low.startswith(_STARTS), *hints,
        ))
    return np.column_stack([np.array(columns, float).T, np.array(rows, float)])


_LAST = frozenset(x.rsplit(".", 1)[-1] for x in ENDINGS)
# How well-known access keys begin, in lower case.
_STARTS = ("sk_live_", "sk_test_", "ghp_", "gho_", "akia", "xoxb-", "xoxp-", "eyj")


def _octets(span: str) -> int:
    parts = re.findall("[0-9]+", span)
    return int(len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts))


@dataclass
class Model:
    trees: dict[str, boosting.Boosted] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)


_GROUP = {kind: group for group, (_, kinds) in GROUPS.items() for kind in kinds}


def _merged(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans, which come by start."""
    starts, ends = [], []
    for a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], model: Model) -> list[list[tuple[str, int, int]]]:
    """What the model adds to each text: the best-scored candidates that overlap nothing taken before them.

    Ties go to the earlier, then the longer candidate, then by kind. All texts' candidates are scored together.
    """
    found = [(i, *p) for i, (text, base) in enumerate(zip(texts, bases)) for p in _free(proposals(text), base)] if model.trees else []
    scored: list[list[tuple]] = [[] for _ in texts]
    for at in range(0, len(found), AT_ONCE):
        part = found[at : at + AT_ONCE]
        x = features([(texts[i], a, b) for i, a, b, _ in part])
        for kind, trees in model.trees.items():
            mine = [j for j, p in enumerate(part) if p[3] == _GROUP[kind]]
            scores = trees.score(x[mine]) if mine else np.zeros(0)
            for j in np.flatnonzero(scores >= model.thresholds[kind]).tolist():
                i, a, b, _ = part[mine[j]]
                scored[i].append((-scores[j], a, -b, kind))
    return [_best(x) if x else [] for x in scored]


def _free(found: list[tuple[int, int, str]], base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """The candidates that overlap no base span; a key may hold digits that look like one, if it is longer by BEYOND at least."""
    if not found or not base:
        return found
    starts, ends = _merged([(a, b) for _, a, b in base])
    held = np.concatenate([[0], np.cumsum(ends - starts)])
    a, b = np.array([p[:2] for p in found]).T
    first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
    inside = (first < last) & (starts[np.minimum(first, len(starts) - 1)] >= a) & (ends[last - 1] <= b)
    free = (first >= last) | (np.array([p[2] == "s" for p in found]) & inside & (b - a - (held[last] - held[np.minimum(first, last)]) >= BEYOND))
    return [p for p, ok in zip(found, free) if ok]


def _best(scored: list[tuple]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []  # disjoint, by start
    for _, a, b, kind in sorted(scored):
        b = -b
        at = bisect_left(taken, (a, b))
        if (at == len(taken) or taken[at][0] >= b) and (at == 0 or taken[at - 1][1] <= a):
            taken.insert(at, (a, b))
            out.append((kind, a, b))
    return out


def training_rows(snippets: list[str], group: str, examples: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, kinds ('' for none) and example numbers of the candidates that meet a generated record or decoy of a group.

    A candidate that is a record whole and exactly is of its kind; one that meets a record or a decoy otherwise is of none.
    """
    maker = Maker(random.Random(f"{seed}:{group}"), sorted({w.lower() for t in snippets for w in re.findall("[A-Za-z]{3,12}", t)}))
    rows, kinds, numbers = [], [], []
    for i in range(2 * examples):
        text, kind, start, end = example(maker, group, snippets, i % 2 == 0)
        for a, b, g in proposals(text):
            if g == group and a < end and start < b:
                rows.append((text, a, b))
                kinds.append(kind if kind and (a, b) == (start, end) else "")
                numbers.append(i)
    return features(rows), np.array(kinds), np.array(numbers)


def train(snippets: list[str], examples: int = EXAMPLES, seed: int = SEED) -> Model:
    """Trees and thresholds for all kinds; every fourth example sets the thresholds."""
    model = Model()
    for group, (_, names) in GROUPS.items():
        x, kinds, numbers = training_rows(snippets, group, examples, seed)
        held = numbers // 2 % 4 == 3
        for kind in names:
            y = (kinds == kind).astype(float)
            trees = boosting.fit(x[~held], y[~held])
            model.thresholds[kind] = boosting.calibrate(trees, x[held], y[held], PRECISION)
            model.trees[kind] = trees
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_TEXTS) -> Model:
    """Trees and thresholds from generated examples in pieces of a bounded sample of texts, drawn by a hash of the text.

    Only the sample's pieces reach the driver: about `sample` of SAMPLE_POINTS code points. Texts are whole
    everywhere else. Without any text, examples have surroundings of made-up words.
    """
    rows = docs.select(named(text_col).alias("_gl_text")).filter(F.length("_gl_text") > 0)
    share = bounded_share(rows.count(), sample)
    mark = F.xxhash64(F.lit(SEED), "_gl_text")
    drawn = rows.filter(F.shiftrightunsigned(mark, 11) / F.lit(float(1 << 53)) < share)
    begin = F.pmod(mark, F.greatest(F.length("_gl_text") - SAMPLE_POINTS, F.lit(0)) + 1)
    pieces = drawn.select(mark.alias("h"), F.col("_gl_text").substr((begin + 1).cast("int"), F.lit(SAMPLE_POINTS)).alias("piece")).distinct().orderBy("h", "piece").limit(2 * sample)
    return train([r["piece"] for r in pieces.collect()])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """The columns `keep` of docs (all by default) with `pii`, the spans in code points (end exclusive) by start, then kind.

    With redact also `redacted`: the text with each span (overlapping ones together) replaced by [KIND].
    Null and empty texts have no spans. Equal texts have equal spans, and spans that begin together come in the
    order of ALL_KINDS. Time grows with the length of a text, not with the square of its spans. Columns of docs
    named pii or redacted are replaced. An empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def spans(texts):
        texts = [t or "" for t in texts]
        bases = [base_spans(t) for t in texts]
        for base, added in zip(bases, added_spans(texts, bases, held.value)):
            rows = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in added]
            yield [dict(kind=k, start=a, end=b, base=own) for k, a, b, own in sorted(rows, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))]

    def cleaned(text, found):
        if text is None:
            return None
        out, at = [], 0
        for s in found:
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def make():
        def of(texts):
            found = list(spans(texts))
            return [found, [cleaned(t, s) for t, s in zip(texts, found)]] if redact else [found]

        return of

    fields = [T.StructField("pii", SPANS)] + [T.StructField("redacted", T.StringType())] * redact
    return map_text(docs, [text_col], make, fields, list(docs.columns) if keep is None else keep)
