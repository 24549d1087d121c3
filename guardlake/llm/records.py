"""Generated records of personal data and secrets in many formats, and decoys that look like them.

They teach the trees of `pii` what the base patterns cannot show: each example is a record or a decoy put
between two pieces of corpus text. Words of records come from the corpus as well.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

#: Endings of domains that records use.
ENDINGS = ("com", "org", "net", "edu", "de", "fr", "es", "it", "io", "co.uk", "gov", "info", "dev", "example")
_HEX, _WORDY = "0123456789abcdef", string.ascii_letters + string.digits


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class Maker:
    """Draws records and decoys; words are lower-case ASCII words to build names from."""

    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words or ["anna", "berg", "carlo", "dune", "elm", "fox", "glen", "hill"]

    def of(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choices(alphabet, k=n))

    def digits(self, n: int) -> str:
        return self.of("0123456789", n)

    def word(self) -> str:
        return self.rng.choice(self.words)

    def pick(self, *options):
        return self.rng.choice(options)

    # records: (hint or '', value); a hint is needed where the value alone says little

    def email(self) -> tuple[str, str]:
        local = self.pick(self.word(), f"{self.word()}.{self.word()}", f"{self.word()}_{self.word()}", f"{self.word()}{self.rng.randrange(100)}", f"{self.word()[0]}.{self.word()}")
        host = [*self.pick([], [], [self.pick("mail", "www", self.word())]), self.word(), *self.pick(*ENDINGS).split(".")]
        at = self.pick("@", " at ", " [at] ", "[at]", "(at)", " (at) ", " AT ", " @ ")
        dots = (" dot ", " [dot] ", "[dot]", "(dot)", " DOT ")
        dot = self.pick(".", *dots) if at != "@" else self.pick(*dots, ".")
        return self.pick("", "", "mail: ", "write to ", "e-mail ", "contact "), local + at + dot.join(host)

    def phone(self) -> tuple[str, str]:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        plain = self.pick(f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"0{self.digits(1)} " + " ".join(self.digits(2) for _ in range(4)), f"0{a}/{b}{c}", f"00{self.digits(2)} {self.digits(2)} {b} {c}")
        if self.rng.random() < 0.65:
            return self.pick("", "", "tel. ", "phone: ", "call ", "mobile "), plain
        return self.pick("phone: ", "tel ", "call me on ", "mobile: ", "fax "), self.pick(f"{a}{b}{c}", f"0{a} {b}{c}", f"{b}-{c}", f"{a} {b} {c}", f"0{a}{b}{c}")

    def card(self) -> tuple[str, str]:
        n = self.pick(16, 16, 16, 15, 14)
        body = self.pick("4", "5", "3", "6") + self.digits(n - 2)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        size = 4 if n == 16 else self.pick(4, 5)
        cut = [number[i : i + size] for i in range(0, n, size)]
        return self.pick("", "card ", "visa ", "pay with ", "card number: ", "credit card "), self.pick(".", "/", "_", " - ", "  ", ".").join(cut)

    def ip(self) -> tuple[str, str]:
        parts = [str(self.rng.randrange(256)) for _ in range(4)]
        six = [f"{self.rng.randrange(1 << 16):x}" for _ in range(8)]
        short = ":".join(["2001", "db8", *six[: self.rng.randrange(1, 3)]]) + "::" + six[7]
        return self.pick("", "", "host ", "server ", "from ip ", "address "), self.pick("[.]".join(parts), "(.)".join(parts), "[.]".join(parts), "[dot]".join(parts), ":".join(six), short)

    def secret(self) -> tuple[str, str]:
        if self.rng.random() < 0.25:
            start, rest = self.pick(("sk_live_", self.of(_WORDY, 24)), ("ghp_", self.of(_WORDY, 36)), ("AKIA", self.of(string.ascii_uppercase + string.digits, 16)), ("xoxb-", f"{self.digits(11)}-{self.of(_WORDY, 24)}"), ("eyJ", f"{self.of(_WORDY, 30)}.{self.of(_WORDY, 40)}.{self.of(_WORDY, 30)}"))
            return self.pick("", "", "key ", "token: "), start + rest
        name = self.pick("token", "TOKEN", "api_key", "apikey", "secret", "client_secret", "access_token", "auth", "password", "private key", "bearer")
        value = self.pick(self.of(_HEX, self.pick(32, 40, 64)), self.of(_HEX, 40), self.of(_HEX, 40).upper(), self.of(_WORDY + "+/", self.pick(20, 32, 44)), self.of(_WORDY, self.pick(16, 24, 32)))
        return name + self.pick(" = ", "=", ": ", ' = "', '="', " = '"), value

    # decoys

    def number_decoy(self) -> str:
        d, w = self.digits, self.word
        y, m, day = self.rng.randrange(1900, 2030), self.rng.randrange(1, 13), self.rng.randrange(1, 29)
        bad = next(x for x in iter(lambda: d(16), None) if not luhn(x))
        grouped = " ".join(bad[i : i + 4] for i in range(0, 16, 4))
        return self.pick(
            f"{y}-{m:02}-{day:02}", f"{day:02}.{m:02}.{y}", f"{m}/{day}/{y}", f"{y}-{m:02}-{day:02} {d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{day:02}.{m:02}.{y} - {day:02}.{m:02}.{y + 1}",
            f"{d(1)}.{d(3)}.{d(3)}", f"{d(2)}.{d(8)}", f"$ {d(4)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"v{d(2)}.{d(2)}.{d(4)}", f"{y}-{y + 5}", f"pp. {d(4)}-{d(4)}", bad, bad, bad, grouped, f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            f"order {d(10)}", f"ref. {d(9)}", f"no. {d(8)}", f"{d(5)}-{d(4)}", f"id={d(12)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)} {d(3)}", f"{d(7)}", f"{d(12)}", f"({d(4)}) {d(2)}", f"item {d(3)}-{d(4)}-{d(2)}",
            ":".join(self.of(_HEX, 2) for _ in range(6)), f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{w()} {d(4)}-{d(3)} {w()}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(4)} x {d(4)} x {d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"isbn {d(10)}", f"{d(6)}-{d(6)}", f"{d(3)}-{d(2)}", "0." + d(15), f"{d(1)}.{d(5)}-{d(5)}", f"rfc {d(4)}",
        )

    def mail_decoy(self) -> str:
        w = self.word
        return self.pick(f"{w()} at {w()}. {w().capitalize()}", f"{w()} at {w()}. {w().capitalize()} {w()}", f"{w()} at {w()}", f"{w()} at {w()} {w()}. {w()}", f"{w()} at {self.digits(1)}.{self.digits(2)}", f"@{w()}", f"{w()} @ {w()}", f"{w()} at the dot {w()}", f"{w()}. At {w()}. {w().capitalize()}", f"{w()} (at) {w()}", f"{w().capitalize()} at {w()}.{w().capitalize()}", f"{w()} dot {w()} at {w()}")

    def secret_decoy(self) -> str:
        w, d, h = self.word, self.digits, lambda n: self.of(_HEX, n)
        return self.pick(
            f"{self.pick('sha256', 'md5', 'commit', 'checksum', 'etag', 'digest', 'rev', 'hash', 'build')}{self.pick(': ', ' ', '=')}{h(self.pick(32, 40, 64))}", f"commit {h(40)}", f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", f"https://{w()}.example/{w()}-{d(4)}/{w()}{d(3)}", f"IMG_{d(8)}_{d(6)}.jpg", f"{w()}{w().capitalize()}{w().capitalize()}{d(1)}",
            f"{w()}_{w()}_{w()}_{d(2)}", f"/{w()}/{w()}/{w()}{d(3)}.txt", f"{w()}-{w()}-{w()}-{d(4)}", f"data:image/png;base64,{self.of(_WORDY, 60)}", f"{d(4)}-{d(2)}-{d(2)}T{d(2)}.{d(2)}.{d(2)}Z", f"{d(20)}", d(16), "-".join(d(4) for _ in range(4)), f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}", f"{w()}={w()}{d(2)}{w()}{w()}", f"{w()} = {w()}.{w()}.{w()}{d(1)}", f"{w()}{w()}{w()}{w()}{d(2)}", f"{w()}.{w()}{d(2)}@{w()}.example.com", f"{d(3)}.{d(3)}.{d(2)}.{d(3)}..{d(4)}",
            f"token {w()}-{w()}-{w()}{d(1)}", f"key: {w()}_{w()}_{w()}{d(1)}", f"password {w()}{w()}{w()}{w()}", h(40), h(32), h(64), self.of(_WORDY, 32),
        )


#: The decoys of each group of candidates, and the kinds of record in it.
GROUPS: dict[str, tuple[Callable[[Maker], str], tuple[str, ...]]] = {
    "m": (Maker.mail_decoy, ("email",)),
    "n": (Maker.number_decoy, ("ip", "card", "phone")),
    "s": (Maker.secret_decoy, ("secret",)),
}


def example(maker: Maker, group: str, snippets: list[str], positive: bool) -> tuple[str, str | None, int, int]:
    """(text, kind or None for a decoy, start, end) of one record or decoy between pieces of corpus text."""
    decoy, kinds = GROUPS[group]
    kind = maker.rng.choice(kinds) if positive else None
    hint, value = getattr(maker, kind)() if kind else ("", decoy(maker))
    if not positive and maker.rng.random() < 0.15:  # a hint of something else nearby is no proof
        hint = maker.pick("phone book ", "mail order ", "the host ", "card game ", "key: ", "call no. ")
    before, after = (maker.rng.choice(snippets) if snippets else " ".join(maker.word() for _ in range(12)) for _ in range(2))
    before, after = before[: maker.rng.randrange(20, 100)], after[maker.rng.randrange(0, 60) :][:80]
    mark = hint[-1:] if hint[-1:] in ("'", '"') else ""
    lead = before + maker.pick(" ", " ", " ", "\n", ", ", ": ") + hint
    tail = mark + maker.pick(" ", " ", ", ", ".\n", ". ", "\n", ")", "") + (after if after[:1].isspace() else " " + after)
    if not lead.strip():
        lead = hint
    return lead + value + tail, kind, len(lead), len(lead) + len(value)
