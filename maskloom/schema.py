"""The records: spans, labels, and configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

#: The labels, their order of precedence, and how much a residual of each weighs.
LABELS = "PERSON ORG BANK_ORG EMAIL PHONE ACCOUNT_ID ADDRESS_BLOCK DOB DATE_GENERIC ALIAS_LABEL GPE LOC OTHER".split()
PRECEDENCE = "EMAIL PHONE ACCOUNT_ID DOB ADDRESS_BLOCK BANK_ORG ORG PERSON ALIAS_LABEL GPE LOC DATE_GENERIC".split()
WEIGHTS = {"PERSON": 3, "ADDRESS_BLOCK": 3, "DOB": 3, "EMAIL": 3, "ACCOUNT_ID": 3, "PHONE": 2, "ORG": 1, "BANK_ORG": 1, "ALIAS_LABEL": 1, "GPE": 1, "LOC": 1, "DATE_GENERIC": 0}

#: start and end in code points, half-open; subtype is what a detector tells apart within a label.
SPAN = "struct<start:int,end:int,text:string,label:string,source:string,confidence:double,subtype:string,attrs:map<string,string>,entity_id:string>"
SPANS = f"array<{SPAN}>"
PLAN = "array<struct<start:int,end:int,original:string,replacement:string,label:string,subtype:string,source:string,entity_id:string,skip:boolean,retries:int,reason:string>>"
FINDINGS = "array<struct<start:int,end:int,text:string,label:string,confidence:double,ignored:string>>"


@dataclass(frozen=True)
class Config:
    """What a run looks for and how it replaces it. ``load`` reads it from YAML."""

    locale: str = "US"
    #: "redact" or "keep_roles": whether role words (Buyer, Seller) are replaced.
    alias_labels: str = "redact"
    generic_dates: bool = False
    cross_doc_consistency: bool = False
    secret_env: str = "MASKLOOM_SECRET"
    secret: str | None = field(default=None, repr=False)
    fail_on_residual: bool = True
    min_confidence: float = 0.5
    ner: bool = True
    #: Names of the detectors to use; all if empty.
    detectors: tuple[str, ...] = ()
    coref: bool = False
    generic_ids: bool = True
    #: Without it any word of eight letters with a country's letters at its fifth place would be a bank code.
    bic_upper_case: bool = True
    protect_headings: bool = True
    gpe_outside_addresses: bool = True
    precedence: tuple[str, ...] = tuple(PRECEDENCE)

    def __post_init__(self) -> None:
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must be from 0 to 1")
        if self.alias_labels not in ("redact", "keep_roles"):
            raise ValueError("alias_labels must be redact or keep_roles")
        if unknown := set(self.precedence) - set(LABELS):
            raise ValueError(f"unknown labels: {sorted(unknown)}")

    def but(self, **changes: Any) -> Config:
        return replace(self, **changes)


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """over laid upon base, mapping by mapping; lists are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | None = None, env: dict[str, str] | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """Defaults, then the YAML file's keys, then overrides; the secret from the variable that secret_env names comes last."""
    import os

    import yaml

    given: dict[str, Any] = {}
    if path:
        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        if not isinstance(given, dict):
            raise ValueError("the configuration must be a mapping")
    given = merged(given, overrides or {})
    if unknown := set(given) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    for name in {"precedence", "detectors"} & set(given):
        given[name] = tuple(given[name])
    cfg = Config(**given)
    found = (os.environ if env is None else env).get(cfg.secret_env)
    return cfg.but(secret=found) if found else cfg
