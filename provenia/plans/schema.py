"""Extraction schemas: YAML files, checked as they load, immutable after. A schema is a program; `plans.compiler` turns it into columns."""

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from importlib.resources import files
from types import MappingProxyType
from typing import Any

import yaml

from provenia.functions.patterns import PatternError, capture_of, java, needs_text

KINDS = ("string", "date", "integer", "decimal")
SEVERITIES = ("warning", "reject")
SEGMENTATIONS = ("cambio_valore",)
#: For each kind of invariant the parameters that name fields, and those that don't with their type.
INVARIANTS: dict[str, tuple[tuple[str, ...], dict[str, tuple[type, ...]]]] = {
    "somma_approssimata": (("addendi", "totale"), {"tolleranza_relativa": (int, float)}),
    "differenza_giorni": (("da", "a", "risultato"), {"offset": (int,)}),
    "valore_minimo": (("campo",), {"minimo": (int, float)}),
    "ordine_date": (("precedente", "successiva"), {}),
    "formato": (("campo",), {"pattern": (str,)}),
}


class SchemaError(ValueError):
    """A schema that can't be used, with the place in it that is wrong."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    mandatory: bool = False
    pattern: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class Invariant:
    id: str
    kind: str
    severity: str
    params: Mapping[str, Any]

    def fields(self) -> list[str]:
        """The fields it refers to, in the order of its parameters."""
        out: list[str] = []
        for p in INVARIANTS[self.kind][0]:
            x = self.params[p]
            out += x if isinstance(x, list | tuple) else [x]
        return out


@dataclass(frozen=True)
class Segmentation:
    kind: str
    pattern: str
    least_pages: int = 1


@dataclass(frozen=True)
class Schema:
    version: int
    document: str
    fields: tuple[Field, ...]
    invariants: tuple[Invariant, ...] = field(default=())
    segmentation: Segmentation | None = None

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def only(self, *names: str) -> "Schema":
        """The schema of these fields alone, with the invariants that refer to no others."""
        _need(set(names) <= {f.name for f in self.fields}, f"unknown fields: {', '.join(sorted(set(names) - {f.name for f in self.fields}))}")
        return replace(self, fields=tuple(f for f in self.fields if f.name in names), invariants=tuple(i for i in self.invariants if set(i.fields()) <= set(names)))


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise SchemaError(what)


def _regex(x: Any, where: str, groups: bool = False, every: bool = False) -> str:
    """A pattern that Python and Java can both say; every: all its matches are looked for."""
    _need(isinstance(x, str) and bool(x), f"{where}: pattern must be a text")
    try:
        java(x)
        group, _ = capture_of(x)
        if every:
            needs_text(x)
    except (re.error, PatternError, OverflowError) as e:
        raise SchemaError(f"{where}: {e}") from e
    _need(not groups or group > 0, f"{where}: pattern needs a group")
    return x


def _is(x: Any, kinds: tuple[type, ...]) -> bool:
    return isinstance(x, kinds) and not isinstance(x, bool)


def _label(rule: Mapping[str, Any], name: str) -> str:
    """The pattern of the value that stands next to a label, to its right in the same line: after blanks and `:`, `.` or `=`, up to `parole` words with one blank between
    them, for two blanks or a tab begin another column."""
    label, words = rule.get("testo"), rule.get("parole", 1)
    _need(isinstance(label, str) and bool(label.split()), f"{name}: testo must be a text")
    _need(_is(words, (int,)) and 1 <= words <= 100, f"{name}: parole must be from 1 to 100")
    told = r"[ \t]+".join(re.escape(w) for w in label.split())
    return _regex(rf"(?<!\w){told}(?!\w)[ \t]*[:.=]*[ \t]*([^\s:.=]\S*(?: \S+){{0,{words - 1}}})", name, every=True)


#: Kinds of extraction rules: each checks a rule's parameters, for the field of this name, and gives the pattern whose one capture is the value.
RULES: dict[str, Callable[[Mapping[str, Any], str], str]] = {"regex": lambda rule, name: _regex(rule.get("pattern"), name, every=True), "etichetta": _label}


def _fields(told: Any) -> tuple[Field, ...]:
    _need(isinstance(told, list) and bool(told), "campi: at least one field")
    out: dict[str, Field] = {}
    for i, c in enumerate(told):
        _need(isinstance(c, dict), f"campi[{i}]: must be a mapping")
        name = c.get("nome")
        _need(isinstance(name, str) and bool(name), f"campi[{i}]: nome is missing")
        _need(name not in out, f"{name}: declared twice")
        _need(c.get("tipo") in KINDS, f"{name}: tipo must be one of {', '.join(KINDS)}")
        mandatory, description, rule = c.get("obbligatorio", False), c.get("descrizione"), c.get("estrazione")
        _need(isinstance(mandatory, bool), f"{name}: obbligatorio must be true or false")
        _need(description is None or isinstance(description, str), f"{name}: descrizione must be a text")
        pattern = None
        if rule is not None:
            _need(isinstance(rule, dict), f"{name}: estrazione must be a mapping")
            _need(rule.get("tipo") in RULES, f"{name}: estrazione must be one of {', '.join(RULES)}")
            pattern = RULES[rule["tipo"]](rule, name)
        out[name] = Field(name, c["tipo"], mandatory, pattern, description)
    return tuple(out.values())


def _invariants(told: Any, fields: tuple[Field, ...]) -> tuple[Invariant, ...]:
    _need(isinstance(told, list), "invarianti: must be a list")
    known, out = {f.name for f in fields}, {}
    for i, v in enumerate(told):
        _need(isinstance(v, dict), f"invarianti[{i}]: must be a mapping")
        name, kind = v.get("id"), v.get("tipo")
        _need(isinstance(name, str) and bool(name), f"invarianti[{i}]: id is missing")
        _need(name not in out, f"{name}: declared twice")
        _need(kind in INVARIANTS, f"{name}: tipo must be one of {', '.join(INVARIANTS)}")
        _need(v.get("severita") in SEVERITIES, f"{name}: severita must be one of {', '.join(SEVERITIES)}")
        params = {k: x for k, x in v.items() if k not in ("id", "tipo", "severita")}
        for p in INVARIANTS[kind][0]:
            x = params.get(p)
            names = x if p == "addendi" and isinstance(x, list) and x else [x]
            _need(all(isinstance(n, str) for n in names), f"{name}: {p} must name fields")
            _need(set(names) <= known, f"{name}: {p} names unknown fields")
        for p, kinds in INVARIANTS[kind][1].items():
            _need(_is(params.get(p), kinds), f"{name}: {p} is missing or of another type")
        if kind == "formato":
            _regex(params["pattern"], name)
        out[name] = Invariant(name, kind, v["severita"], MappingProxyType(params))
    return tuple(out.values())


def _segmentation(told: Any) -> Segmentation | None:
    if told is None:
        return None
    _need(isinstance(told, dict), "segmentazione: must be a mapping")
    _need(told.get("tipo") in SEGMENTATIONS, f"segmentazione: tipo must be one of {', '.join(SEGMENTATIONS)}")
    least = told.get("minimo_pagine", 1)
    _need(_is(least, (int,)) and least >= 1, "segmentazione: minimo_pagine must be 1 or more")
    return Segmentation(told["tipo"], _regex(told.get("pattern"), "segmentazione", groups=True), least)


def parse(text: str) -> Schema:
    try:
        told = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SchemaError(f"not YAML: {e}") from e
    _need(isinstance(told, dict), "a schema must be a mapping")
    _need(_is(told.get("schema_version"), (int,)), "schema_version must be a whole number")
    _need(isinstance(told.get("documento"), str) and bool(told["documento"]), "documento is missing")
    fields = _fields(told.get("campi"))
    invariants = told.get("invarianti")
    return Schema(told["schema_version"], told["documento"], fields, _invariants([] if invariants is None else invariants, fields), _segmentation(told.get("segmentazione")))


def load(path: str) -> Schema:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except (OSError, UnicodeDecodeError) as e:
        raise SchemaError(f"{path}: {e}") from e


def shipped(name: str) -> Schema:
    """A schema that comes with the package: bolletta_luce_it, bolletta_gas_it or cte_it."""
    return parse((files("provenia") / "schemas" / f"{name}.yaml").read_text(encoding="utf-8"))
