"""Programs over groups as plug-ins: a descriptor says what one needs and returns, and its results are held to it.

A descriptor names the columns that a program requires, its parameters with types and defaults, and for each column
that it returns a name, a type and a scope: per variant, or one value for each credible set or for the whole group.
Registered programs run as grouped Spark jobs; a result that breaks the contract fails with the column's name.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.operators import signals
from lociform.operators.regional import Linkage

#: Types that a column may have, scopes, and kinds of parameters.
TYPES = {"double": "double", "int": "bigint", "string": "string", "boolean": "boolean"}
SCOPES = ("per_snp", "per_credible_set", "per_group")
KINDS = {"float": float, "int": int, "string": str, "boolean": lambda x: x if isinstance(x, bool) else {"true": True, "false": False}[str(x).lower()], "select": str}

Program = Callable[[pd.DataFrame, dict], pd.DataFrame]


class ContractError(ValueError):
    """A descriptor, a parameter or a result that is not as declared."""


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    default: object
    options: tuple[str, ...] = ()

    def value(self, given: object) -> object:
        try:
            out = KINDS[self.type](given)
        except (ValueError, TypeError, KeyError) as e:
            raise ContractError(f"parameter '{self.name}' is not of type {self.type}: {given!r}") from e
        if self.type == "select" and out not in self.options:
            raise ContractError(f"parameter '{self.name}' is none of {', '.join(self.options)}: {out!r}")
        return out


@dataclass(frozen=True)
class Output:
    raw: str
    name: str
    scope: str
    type: str


@dataclass(frozen=True)
class Descriptor:
    tool: str
    version: str
    requires: tuple[str, ...]
    outputs: tuple[Output, ...]
    parameters: tuple[Parameter, ...] = ()
    key: str = "variant"
    label: str = ""
    description: str = ""
    set_column: str = field(default="")

    def __post_init__(self) -> None:
        names = [o.name for o in self.outputs]
        if not self.tool or not self.outputs:
            raise ContractError("a descriptor needs a tool and at least one output column")
        for o in self.outputs:
            if o.type not in TYPES:
                raise ContractError(f"column '{o.name}' has invalid type: {o.type}")
            if o.scope not in SCOPES:
                raise ContractError(f"column '{o.name}' has invalid scope: {o.scope} (must be one of {', '.join(SCOPES)})")
            if names.count(o.name) > 1 or o.name == self.key:
                raise ContractError(f"column '{o.name}' is declared twice")
        for p in self.parameters:
            if p.type not in KINDS:
                raise ContractError(f"parameter '{p.name}' has invalid type: {p.type}")
        if any(o.scope == "per_credible_set" for o in self.outputs) and self.set_column not in names:
            raise ContractError("columns of scope per_credible_set need a set_column among the outputs")

    @staticmethod
    def read(text: str) -> Descriptor:
        """A descriptor from JSON, its lists as objects with the fields above."""
        told = json.loads(text)
        told["requires"] = tuple(told.get("requires", ()))
        told["outputs"] = tuple(Output(**o) for o in told.get("outputs", ()))
        told["parameters"] = tuple(Parameter(**(p | {"options": tuple(p.get("options", ()))})) for p in told.get("parameters", ()))
        return Descriptor(**told)


_REGISTRY: dict[str, tuple[Descriptor, Program]] = {}


def register(descriptor: Descriptor, program: Program, replace: bool = False) -> None:
    if descriptor.tool in _REGISTRY and not replace:
        raise ContractError(f"tool '{descriptor.tool}' is registered already")
    _REGISTRY[descriptor.tool] = descriptor, program


def descriptor_of(tool: str) -> Descriptor:
    if tool not in _REGISTRY:
        raise ContractError(f"no tool '{tool}'; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[tool][0]


def tools() -> list[Descriptor]:
    return [d for _, (d, _) in sorted(_REGISTRY.items())]


def settled(descriptor: Descriptor, given: dict | None) -> dict:
    """Every parameter of the tool, given or by default, checked."""
    given = given or {}
    unknown = sorted(set(given) - {p.name for p in descriptor.parameters})
    if unknown:
        raise ContractError(f"tool '{descriptor.tool}' has no parameter '{unknown[0]}'")
    return {p.name: p.value(given.get(p.name, p.default)) for p in descriptor.parameters}


def held_to(descriptor: Descriptor, result: pd.DataFrame) -> pd.DataFrame:
    """The result with declared names and types in order, or the first breach of the contract by name."""
    where = f"tool '{descriptor.tool}' {descriptor.version}"
    if descriptor.key not in result.columns:
        raise ContractError(f"{where}: key column '{descriptor.key}' is missing")
    raw = {o.raw for o in descriptor.outputs}
    for c in result.columns:
        if c != descriptor.key and c not in raw:
            raise ContractError(f"{where}: column '{c}' is not declared")
    for o in descriptor.outputs:
        if o.raw not in result.columns:
            raise ContractError(f"{where}: declared column '{o.raw}' is missing")
    if result[descriptor.key].isna().any():
        raise ContractError(f"{where}: a row has no '{descriptor.key}'")
    if result[descriptor.key].duplicated().any():
        raise ContractError(f"{where}: '{descriptor.key}' {result[descriptor.key][result[descriptor.key].duplicated()].iloc[0]!r} comes twice")
    out = pd.DataFrame({descriptor.key: result[descriptor.key]})
    for o in descriptor.outputs:
        try:
            own = result[o.raw]
            if o.type == "int" and (pd.to_numeric(own).dropna() % 1 != 0).any():
                raise ValueError("fractions")
            if o.type == "boolean" and not own.dropna().isin([True, False]).all():
                raise ValueError("neither true nor false")
            out[o.name] = own.astype({"double": "float64", "int": "Int64", "string": "string", "boolean": "boolean"}[o.type])
        except (ValueError, TypeError) as e:
            raise ContractError(f"{where}: column '{o.name}' is not of type {o.type}: {e}") from e
    for o in descriptor.outputs:
        groups = {"per_group": np.zeros(len(out)), "per_credible_set": out[descriptor.set_column] if descriptor.set_column else None}.get(o.scope)
        if groups is not None and (out[o.name].groupby(groups).nunique(dropna=False) > 1).any():
            raise ContractError(f"{where}: column '{o.name}' of scope {o.scope} has several values")
    return out


def run(tool: str, df: DataFrame, group: str, parameters: dict | None = None) -> DataFrame:
    """group, key and the declared columns, method and method_version: the tool over each group of df.

    A group is what one task holds, a locus for instance; its rows meet there.
    """
    descriptor, program = descriptor_of(tool), _REGISTRY[tool][1]
    for c in (group, descriptor.key, *descriptor.requires):
        if c not in df.columns:
            raise ContractError(f"tool '{tool}' requires column '{c}'; there are {', '.join(df.columns)}")
    values = settled(descriptor, parameters)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = held_to(descriptor, program(pdf.drop(columns=[group]), values))
        out.insert(0, group, pdf[group].iloc[0])
        return out

    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = ", ".join([f"`{group}` {kind(group)}", f"`{descriptor.key}` {kind(descriptor.key)}", *(f"`{o.name}` {TYPES[o.type]}" for o in descriptor.outputs)])
    needed = df.select(*dict.fromkeys([group, descriptor.key, *descriptor.requires]))
    return needed.groupBy(group).applyInPandas(one, schema).withColumns({"method": F.lit(tool), "method_version": F.lit(descriptor.version)})


# ---- programs of this library -----------------------------------------------------------------


def _credible(pdf: pd.DataFrame, p: dict) -> pd.DataFrame:
    """Sum of single effects of one locus."""
    pdf = pdf.sort_values("variant").reset_index(drop=True)
    r = Linkage.of_dosages(pdf["dosages"])
    keep, _, used = signals.checked(pdf["z"].to_numpy(np.float64)[:, None], r, p["shrink"])
    plain, z = r.take(keep), pdf["z"].to_numpy(np.float64)[keep, None]
    fit = signals.sum_of_effects(z, [plain.shrunk(used)], np.array([p["n"]]), effects=p["effects"])
    number, cover = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
    for k, (e, members, _) in enumerate(signals.credible_sets(fit, [plain], p["coverage"]), 1):
        fresh = [keep[m] for m in members if np.isnan(number[keep[m]])]
        number[fresh], cover[fresh] = k, fit.alpha[e][members].sum()
    pip = np.full(len(pdf), np.nan)
    pip[keep] = fit.pip
    return pd.DataFrame({"variant": pdf["variant"], "pip": pip, "set": number, "set_coverage": cover})


def _selected(pdf: pd.DataFrame, p: dict) -> pd.DataFrame:
    """Stepwise signals of one locus with joint effects, all other variants given them."""
    pdf = pdf.sort_values("variant").reset_index(drop=True)
    m = signals.joint_model(pdf["z"].to_numpy(np.float64), Linkage.of_dosages(pdf["dosages"]).shrunk(p["shrink"]), p["n"], collinear=p["collinear"])
    out = pd.DataFrame({"variant": pdf["variant"], "selected": False, "b_joint": np.nan, "p_joint": np.nan, "p_given": np.nan, "reliability": m["verdict"]})
    for c, e, q in zip(m["chosen"], m["effect"], m["p_joint"]):
        out.loc[c, ["selected", "b_joint", "p_joint", "p_given"]] = [True, e, q, q]
    out.loc[m["others"], "p_given"] = m["p_given"]
    return out


register(
    Descriptor(
        "single_effects", "1.0", ("z", "dosages"), (Output("pip", "pip", "per_snp", "double"), Output("set", "credible_set", "per_snp", "int"), Output("set_coverage", "set_coverage", "per_credible_set", "double")),
        (Parameter("n", "float", 1e4), Parameter("effects", "int", 10), Parameter("coverage", "float", 0.95), Parameter("shrink", "float", 0.1)), label="Credible sets", set_column="credible_set",
    ), _credible,
)
register(
    Descriptor(
        "joint_selection", "1.0", ("z", "dosages"),
        (Output("selected", "selected", "per_snp", "boolean"), Output("b_joint", "b_joint", "per_snp", "double"), Output("p_joint", "p_joint", "per_snp", "double"), Output("p_given", "p_given", "per_snp", "double"), Output("reliability", "reliability", "per_group", "string")),
        (Parameter("n", "float", 1e4), Parameter("collinear", "float", 0.9), Parameter("shrink", "float", 0.05)), label="Independent signals",
    ), _selected,
)
