"""The rule catalogue and the dimension tables, as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    """needs: strings of which one must stand in the lower-cased text, or the pattern cannot match; none if it is not known."""

    rule_id: str
    severity: str
    pattern: str
    needs: tuple[str, ...] = ()


SEVERITY_RANK = {"Info": 0, "Low": 1, "Medium": 2, "High": 3}
SEVERITY_WEIGHT = {"Info": 0, "Low": 6, "Medium": 20, "High": 50}

# The patterns of the rules that are one regex each, in catalogue order.
REGEX_RULES = (
    Rule("INJ-001", "High", r"(?i)\bignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|directions?|prompts?)\b", ("ignore",)),
    Rule("INJ-002", "High", r"(?i)\bdisregard\s+(?:your\s+)?(?:the\s+)?(?:system\s+)?(?:prompt|instructions?|rules?)\b", ("disregard",)),
    Rule("INJ-003", "High", r"(?i)\[/?\s*system\s*\]|<\|\s*system\s*\|>", ("system",)),
    Rule("INJ-004", "High", r"(?i)\bnew\s+instructions?\s*[:\-]", ("instruction",)),
    Rule("INJ-005", "High", r"(?i)\byou\s+are\s+now\s+(?:a|an|in|the|going|going to|allowed|free|operating|acting|playing)\b", ("you",)),
    Rule("INJ-006", "High", r"<\|(?:im_start|im_end|endoftext|fim_prefix|fim_middle|fim_suffix)\|>", ("<|",)),
    Rule("INJ-007", "High", r"(?i)\b(?:enable|activate|enter|engage)\s+(?:jailbreak|dev\s*mode|developer\s*mode|god\s*mode)\b|\bjailbreak\s*(?:mode|prompt)\b", ("jailbreak", "mode")),
    Rule("ENC-003", "Medium", r"(?i)\bdata:[a-z]+/[a-z0-9.+\-]+(?:;[a-z0-9\-]+=[a-z0-9.\-]+)*(?:;base64)?,[A-Za-z0-9+/=%._\-]{8,}", ("data:",)),
)
# Markers of HTML served as text.
HTML_ROOT = r"(?i)<!doctype\s+html|<\s*html\b"
HTML_OPENER = r"(?i)<\s*(script|iframe|style|svg|object|embed|form|head|body)\b"
HTML_CLOSE = r"</[a-zA-Z][a-zA-Z0-9]*\s*>"
HTML_CLOSE_LEAST, HTML_OPENERS_LEAST = 100, 2
BASE64_LEAST, HEX_LEAST, TOKEN_LEAST, SAMPLE_BYTES = 40, 64, 200, 64

SENTINEL_START, SENTINEL_END, SENTINEL_CLOSE = "<|guardlake_external_start:", "<|guardlake_external_end:", "|>"

# Content type names and aliases.
CONTENT_TYPES = {"html": "Html", "markdown": "Markdown", "md": "Markdown", "json": "Json", "text": "PlainText", "plain": "PlainText", "plaintext": "PlainText", "plain_text": "PlainText", "log": "Log"}

# Capabilities with their least tier (T0 to T3 are 0 to 3, T3+ is 4) and whether they always need a grant.
CAPABILITIES = (
    ("ReadSessionInfo", 0, False), ("ReadSystemStatus", 0, False), ("ManageSession", 1, False), ("SendMessage", 1, False),
    ("FetchExternalContent", 1, True), ("ModifyInfrastructure", 2, False), ("ConfigureConductor", 2, False), ("ReadHostFile", 3, False),
    ("WriteHostFile", 3, False), ("ExecuteHostCommand", 3, False), ("ModifyGitState", 3, False), ("ExternalNetworkWrite", 3, False),
    ("ServiceControl", 3, False), ("BreakGlass", 4, False),
)
# Actions, the capability of each, and the parameter that is its resource.
ACTIONS = (
    ("ListSessions", "ReadSessionInfo", None), ("GetSessionStatus", "ReadSessionInfo", None), ("ReadSessionOutput", "ReadSessionInfo", None),
    ("ListGroups", "ReadSessionInfo", None), ("GetSystemStatus", "ReadSessionInfo", None), ("CreateSession", "ManageSession", None),
    ("LaunchSession", "ManageSession", None), ("StartSession", "ManageSession", None), ("StopSession", "ManageSession", None),
    ("RestartSession", "ManageSession", None), ("SendMessage", "SendMessage", None), ("RemoveSession", "ManageSession", None),
    ("FetchExternalContent", "FetchExternalContent", None), ("CreateWorktree", "ModifyInfrastructure", None), ("FinishWorktree", "ModifyInfrastructure", None),
    ("SetSessionParent", "ModifyInfrastructure", None), ("ClearSessionParent", "ModifyInfrastructure", None), ("RenameSession", "ModifyInfrastructure", None),
    ("MoveSessionToGroup", "ModifyInfrastructure", None), ("ClearSessionGroup", "ModifyInfrastructure", None), ("ConfigureConductor", "ConfigureConductor", None),
    ("ReadHostFile", "ReadHostFile", "path"), ("WriteHostFile", "WriteHostFile", "path"), ("ModifyGitState", "ModifyGitState", "repo"),
    ("ExecuteHostCommand", "ExecuteHostCommand", None), ("RestartService", "ServiceControl", None), ("ExternalNetworkWrite", "ExternalNetworkWrite", "domain"),
    ("BreakGlass", "BreakGlass", "cwd"),
)
# Origins with their zone and default ceiling.
ORIGINS = (
    ("LocalCli", "ControlPlane", 4), ("BridgeTelegram", "Ingress", 3), ("BridgeSlack", "Ingress", 1),
    ("AgentGenerated", "AgentRuntime", 1), ("SystemHeartbeat", "ControlPlane", 1), ("HumanApproved", "ControlPlane", 4),
)
# Zone transitions allowed, with the least ceiling; a zone may always reach itself.
ZONES = ("Ingress", "ControlPlane", "AgentRuntime", "HostPrivileged")
TRANSITIONS = (("Ingress", "ControlPlane", 0), ("AgentRuntime", "ControlPlane", 0), ("ControlPlane", "AgentRuntime", 0), ("ControlPlane", "HostPrivileged", 3))
# What in a session's output says that a task is done; and, in order, what says in which state the session is.
COMPLETION = r"(?mi)(task complete|done\.|finished\.|completed successfully)"
STATUS_PATTERNS = (("Waiting", r"(?m)(╰─|>\s*$|What would you like)"), ("Error", r"(?mi)(^error:|panic|fatal error|segmentation fault)"), ("Running", r"(Read\(|Edit\(|Bash\(|Write\(|Grep\(|Glob\()"))
# What in an output asks for a decision, says that a tool is missing, and the ceilings of execution classes.
DECISION_PHRASES = ("?", "which option", "should I", "do you want", "please choose", "waiting for", "your decision", "approve", "confirm")
TOOL_MISSING = ("command not found", ": not found", "No such file or directory")
EXECUTION_CLASSES = (("OfflineWorker", 0), ("ResearchWorker", 1), ("Builder", 1))


def regex_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r.rule_id, r.severity, r.pattern) for i, r in enumerate(REGEX_RULES)], "position int, rule_id string, severity string, pattern string")


def status_patterns(spark: SparkSession, tools: tuple[str, ...] = ("default",)) -> DataFrame:
    """tool, position, state, pattern: what each tool's output says of its session, in order; 'default' serves tools without rows."""
    return spark.createDataFrame([(t, i, s, p) for t in tools for i, (s, p) in enumerate(STATUS_PATTERNS)], "tool string, position int, state string, pattern string")


SIGNAL_SCHEMA = "tool string, position int, kind string, state string, confidence string, pattern string"


def signal_patterns(spark: SparkSession, tools: tuple[str, ...] = ("default",)) -> DataFrame:
    """What each tool's output says, in order: that a task is done, which it says itself (High), then the states that it shows (Medium)."""
    rows = [("Completion", None, "High", COMPLETION), *(("Status", state, "Medium", p) for state, p in STATUS_PATTERNS)]
    return spark.createDataFrame([(t, i, *row) for t in tools for i, row in enumerate(rows)], SIGNAL_SCHEMA)


def actions(spark: SparkSession) -> DataFrame:
    tiers = {c: (t, g) for c, t, g in CAPABILITIES}
    rows = [(a, c, *tiers[c], r, a == "FetchExternalContent") for a, c, r in ACTIONS]
    return spark.createDataFrame(rows, "action string, capability string, required_tier int, requires_grant boolean, resource_param string, needs_sanitizing boolean")


def origins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ORIGINS), "origin_kind string, zone string, default_ceiling int")


def transitions(spark: SparkSession) -> DataFrame:
    rows = [*TRANSITIONS, *((z, z, 0) for z in ZONES)]
    return spark.createDataFrame(rows, "zone string, target_zone string, least_ceiling int")
