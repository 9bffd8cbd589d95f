"""Policies: what happens to each category, above which confidence, under which label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed list of categories.
CATEGORIES = (
    "PERSON_NAME", "EMAIL", "PHONE", "ADDRESS", "SSN", "BANK_ACCOUNT", "CREDIT_CARD", "PASSPORT", "DRIVERS_LICENSE",
    "DATE_OF_BIRTH", "IP_ADDRESS", "URL", "API_KEY", "PASSWORD", "SECRET", "COMPANY_INTERNAL", "PROJECT_NAME", "LOCATION",
    "INDIRECT_IDENTIFIER", "OTHER",
)
ACTIONS = ("replace", "redact", "ignore", "review")
#: Fixed risk of categories that outrank others; all else has risk 0.
RISK = {"SECRET": 100, "PASSWORD": 100, "API_KEY": 100, "SSN": 95, "CREDIT_CARD": 95, "BANK_ACCOUNT": 95, "PASSPORT": 90, "DRIVERS_LICENSE": 90}


class PolicyError(ValueError):
    """A policy that contradicts itself or names what does not exist."""


@dataclass(frozen=True)
class Policy:
    name: str
    version: int = 1
    minimum_confidence: float = 0.7
    default_action: str = "ignore"
    actions: dict[str, str] = field(default_factory=dict)
    category_confidence: dict[str, float] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    quarantine: bool = True
    warn_only: bool = False
    auto_replace: bool = False

    def __post_init__(self) -> None:
        for known, given, what in ((CATEGORIES, [*self.actions, *self.category_confidence, *self.labels], "category"), (ACTIONS, [self.default_action, *self.actions.values()], "action")):
            if unknown := set(given) - set(known):
                raise PolicyError(f"unknown {what}: {', '.join(sorted(unknown))}")
        if any(not 0 <= x <= 1 for x in (self.minimum_confidence, *self.category_confidence.values())):
            raise PolicyError("confidence outside 0 to 1")
        if self.version < 1:
            raise PolicyError("versions begin at 1")
        if self.warn_only and self.quarantine:
            raise PolicyError("warn_only and quarantine exclude each other")

    def action(self, category: str) -> str:
        return self.actions.get(category, self.default_action)

    def label(self, category: str) -> str:
        return self.labels.get(category, category)

    def threshold(self, category: str) -> float:
        return self.category_confidence.get(category, self.minimum_confidence)

    def replaced(self, category: str) -> bool:
        """Whether findings of the category leave the text."""
        action = self.action(category)
        return action in ("replace", "redact") or (action == "review" and self.auto_replace)

    @property
    def numbered_labels(self) -> list[str]:
        return sorted({self.label(c) for c in CATEGORIES if self.action(c) != "redact" and self.replaced(c)})

    @property
    def redacted_labels(self) -> list[str]:
        return sorted({self.label(c) for c in CATEGORIES if self.action(c) == "redact"})

    def rows(self) -> list[tuple]:
        return [(self.name, c, self.action(c), self.label(c), float(self.threshold(c)), RISK.get(c, 0), self.replaced(c)) for c in CATEGORIES]

    def dimension(self, spark: SparkSession) -> DataFrame:
        """One row a category, 20 in all: small enough to broadcast whatever the data."""
        return spark.createDataFrame(self.rows(), "policy string, category string, action string, label string, threshold double, risk int, replaced boolean")

    def lookup(self, of: str, category: Column) -> Column:
        """Column: ``action``, ``label``, ``threshold`` or ``replaced`` of a category."""
        return F.element_at(_map({c: getattr(self, of)(c) for c in CATEGORIES}), category)


#: Fixed names of a policy file's keys, and the fields they fill.
_FILE_KEYS = {
    "name": "name", "version": "version", "minimum_confidence": "minimum_confidence", "default_action": "default_action", "actions": "actions",
    "category_confidence": "category_confidence", "placeholders": "labels",
}
_IGNORED_KEYS = {"schema_version", "description", "ollama_prompt_hints", "verification_strict", "review_behavior"}
_REVIEW_KEYS = {"quarantine", "warn_only", "auto_replace"}


def policy_of(text: str) -> Policy:
    """The policy that a YAML or JSON mapping describes; whatever is wrong with it raises ``PolicyError``."""
    import json

    try:
        import yaml
    except ImportError:  # JSON is all that can be read then
        yaml = None
    try:
        found = json.loads(text) if yaml is None else yaml.safe_load(text)
    except Exception as error:
        raise PolicyError(f"a policy that cannot be read: {error}") from error
    if not isinstance(found, dict):
        raise PolicyError("a policy must be a mapping")
    if unknown := set(map(str, found)) - set(_FILE_KEYS) - _IGNORED_KEYS:
        raise PolicyError(f"unknown keys: {', '.join(sorted(unknown))}")
    if missing := {"name", "version", "minimum_confidence", "actions"} - set(found):
        raise PolicyError(f"missing keys: {', '.join(sorted(missing))}")
    if found.get("schema_version", 1) != 1:
        raise PolicyError("only schema_version 1 is known")
    review = found.get("review_behavior") or {}
    if not isinstance(review, dict) or set(review) - _REVIEW_KEYS or not all(isinstance(x, bool) for x in review.values()):
        raise PolicyError("review_behavior holds quarantine, warn_only and auto_replace, each true or false")
    try:
        return Policy(**{_FILE_KEYS[k]: v for k, v in found.items() if k in _FILE_KEYS}, **review)
    except (TypeError, ValueError) as error:
        raise error if isinstance(error, PolicyError) else PolicyError(str(error)) from error


def load_policies(spark: SparkSession, path: str) -> dict[str, Policy]:
    """Policies by name of the YAML or JSON files at a path or pattern; names must differ. Policy files are few and small."""
    found = [policy_of(r["value"]) for r in spark.read.text(path, wholetext=True).collect()]
    if len({p.name for p in found}) < len(found):
        raise PolicyError("two policies of one name")
    return {p.name: p for p in found}


def _map(values: dict) -> Column:
    """A map literal of plain names, numbers and booleans."""

    def sql(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)

    return F.expr(f"map({', '.join(sql(x) for pair in values.items() for x in pair)})")


def risk(category: Column) -> Column:
    return F.coalesce(F.element_at(_map(RISK), category), F.lit(0))


def _actions(**groups: str) -> dict[str, str]:
    return {c: action for action, names in groups.items() for c in names.split()}


_LABELS = {"PERSON_NAME": "PERSON", "PROJECT_NAME": "PROJECT"}
DEFAULT = Policy(
    "default", 1, 0.7, "ignore",
    _actions(
        replace="PERSON_NAME EMAIL PHONE ADDRESS DATE_OF_BIRTH IP_ADDRESS URL COMPANY_INTERNAL PROJECT_NAME LOCATION",
        redact="SSN BANK_ACCOUNT CREDIT_CARD PASSPORT DRIVERS_LICENSE API_KEY PASSWORD SECRET", review="INDIRECT_IDENTIFIER", ignore="OTHER",
    ),
    labels=_LABELS | {"OTHER": "SENSITIVE"},
)
STRICT = Policy("strict", 1, 0.55, "review", _actions(replace="EMAIL PHONE", redact="SSN CREDIT_CARD API_KEY PASSWORD SECRET"), labels=_LABELS)
AI_SAFE = Policy(
    "ai-safe", 1, 0.7, "review",
    _actions(replace="PERSON_NAME EMAIL PHONE ADDRESS COMPANY_INTERNAL PROJECT_NAME", redact="SSN API_KEY PASSWORD SECRET", ignore="OTHER"),
    {"PERSON_NAME": 0.75, "INDIRECT_IDENTIFIER": 0.6, "API_KEY": 0.5}, _LABELS,
)
POLICIES = {p.name: p for p in (DEFAULT, STRICT, AI_SAFE)}
