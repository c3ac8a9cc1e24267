"""Per-row computed values: trees of fields compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..structure import Structure

CHANNELS = ("r", "g", "b", "a")


class FieldError(ValueError):
    """A field that does not fit its domain or input."""


@dataclass(frozen=True)
class Field:
    """domain: atom, residue or any; kind: scalar, color or string; columns by channel name."""

    domain: str
    kind: str
    columns: dict
    #: Volumes that the field samples; None stands for the nearest one.
    volumes: tuple = ()

    @property
    def value(self) -> Column:
        return self.columns["value"]


def constant(x) -> Field:
    if isinstance(x, str):
        return Field("any", "string", {"value": F.lit(x)})
    if isinstance(x, (list, tuple)):
        return Field("any", "color", {c: F.lit(float(v)) for c, v in zip(CHANNELS, x)})
    return Field("any", "scalar", {"value": F.lit(float(x))})


def attribute(name: str, domain: str = "atom", lift: bool = False, own: str = "atom") -> Field:
    """A column; ``own`` is the domain that holds it, and lifting it onto atoms must be asked for."""
    if own != domain and not (own == "residue" and domain == "atom" and lift):
        raise FieldError(f"{name}: {own} column in a {domain} field needs lift")
    return Field(domain, "scalar", {"value": F.col(name).cast("double")})


def categorical(x: Field, cases: dict, fallback) -> Field:
    """The first case less than 0.5 away, integer keys in ascending order first."""
    ints = sorted((k for k in cases if float(k) >= 0 and float(k) == int(float(k))), key=float)
    order = [*ints, *(k for k in cases if k not in ints)]
    other = fallback if isinstance(fallback, Field) else constant(fallback)
    made = {k: (v if isinstance(v, Field) else constant(v)) for k, v in cases.items()}
    cols = {}
    for c, last in other.columns.items():
        out = last
        for k in reversed(order):
            out = F.when(F.abs(x.value - F.lit(float(k))) < 0.5, made[k].columns[c]).otherwise(out)
        cols[c] = out
    return Field(x.domain, other.kind, cols, x.volumes)


def linear(x: Field, domain: tuple = (0, 1), range_: tuple = (0, 1), overflow: str = "clamp") -> Field:
    lo, hi = map(float, domain)
    if lo == hi:
        raise FieldError("empty domain")
    u = (x.value - F.lit(lo)) / F.lit(hi - lo)
    outside = (u < 0) | (u > 1)
    if overflow == "clamp":
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
    elif overflow == "wrap":
        u = F.when(outside, u - F.floor(u)).otherwise(u)
    elif overflow == "fail":
        u = F.when(outside, F.raise_error(F.lit("value outside the domain")).cast("double")).otherwise(u)
    else:
        raise FieldError(overflow)
    return Field(x.domain, "scalar", {"value": F.lit(float(range_[0])) + u * F.lit(float(range_[1]) - float(range_[0]))}, x.volumes)


def piecewise(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between sorted stops, constant beyond."""
    out = F.lit(float(stops[-1][1]))
    for (t0, v0), (t1, v1) in reversed(list(zip(stops, stops[1:]))):
        if t1 > t0:
            out = F.when(x < t1, F.lit(float(v0)) + (x - F.lit(float(t0))) / F.lit(float(t1 - t0)) * F.lit(float(v1 - v0))).otherwise(out)
    return F.when(x <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def colormap(x: Field, stops: list[tuple[float, tuple]]) -> Field:
    stops = sorted(stops, key=lambda s: s[0])
    cols = {c: piecewise(x.value, [(t, rgba[i]) for t, rgba in stops]) for i, c in enumerate(CHANNELS)}
    return Field(x.domain, "color", cols, x.volumes)


def curve(stops: list[tuple[float, float]], t: float, overflow: str = "clamp") -> Field:
    """A value of the global time, computed when the field is built."""
    stops = sorted(stops)
    lo, hi = stops[0][0], stops[-1][0]
    if not lo <= t <= hi:
        if overflow == "fail":
            raise FieldError("time outside the curve")
        t = (lo + (t - lo) % (hi - lo) if hi > lo else lo) if overflow == "wrap" else min(max(t, lo), hi)
    for (t0, v0), (t1, v1) in zip(stops, stops[1:]):
        if t0 <= t <= t1:
            return constant(v0 + (v1 - v0) * ((t - t0) / (t1 - t0) if t1 > t0 else 0))
    return constant(stops[0][1])


def annotation(domain: str, name: str, missing: str = "fallback", fallback: float | str | None = None) -> Field:
    """A column of external values; absent ones fall back or fail."""
    other = F.lit(fallback) if missing == "fallback" else F.raise_error(F.lit(f"{name}: missing value")).cast("double")
    return Field(domain, "string" if isinstance(fallback, str) else "scalar", {"value": F.coalesce(F.col(name), other)})


def volume_sample(name: str | None = None) -> Field:
    """The value of a volume at each atom; without a name, of the nearest volume of the scene.

    ``with_volume`` puts the values into the rows.
    """
    return Field("atom", "scalar", {"value": F.col(volume_column(name))}, (name,))


def volume_column(name: str | None) -> str:
    return f"__volume_{name or 'nearest'}"


def with_volume(rows: DataFrame, key: str, samples: DataFrame, grid, name: str | None = None) -> DataFrame:
    """``rows`` (key, x, y, z ...) with the volume's trilinear value at each, 0 outside."""
    from . import volume

    values = volume.sample(rows.select(key, "x", "y", "z"), samples, grid, key)
    return rows.join(values.withColumnRenamed("value", volume_column(name)), key)


def reads_nearest_volume(f: Field) -> bool:
    return None in f.volumes


def by_potential(stops: list, limit: float, name: str | None = None) -> Field:
    return colormap(linear(volume_sample(name), (-limit, limit)), stops)


def chain_identity(s: Structure) -> DataFrame:
    """(chain, identity): what names a chain in records from elsewhere."""
    return s.chains.select("chain", F.struct("model", F.col("labelId").alias("chainLabel"), F.col("authId").alias("chainAuth")).alias("identity"))


def residue_identity(s: Structure) -> DataFrame:
    """(residue, identity): the chain's parts, sequence numbers, insertion code and component."""
    rows = s.residues.join(s.chains, "chain")
    parts = F.struct("model", F.col("labelId").alias("chainLabel"), F.col("authId").alias("chainAuth"), "labelSeq", "authSeq", F.col("insertionCode").alias("insCode"), "comp")
    return rows.select("residue", parts.alias("identity"))


def join_annotation(rows: DataFrame, records: DataFrame, keys: list[str], value: str, duplicates: str = "error", order: str | None = None) -> DataFrame:
    """``rows`` with ``value`` of the record of equal identity (missing parts are equal).

    duplicates: 'error' raises if an identity has several records, 'first' and 'last' pick by
    ``order``.
    """
    if not keys:
        raise FieldError("an identity needs a chain")
    held = records.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(value).alias(value), *([F.col(order).alias("__o")] if order else []))
    ids = [f"__{k}" for k in keys]
    if duplicates == "error":
        many = held.groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1")
        if not many.isEmpty():
            raise FieldError(f"several records for {many.first().asDict()}")
        one = held
    else:
        pick = F.min_by if duplicates == "first" else F.max_by
        one = held.groupBy(*ids).agg(pick(value, "__o").alias(value))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(one, cond, "left").drop(*ids, "__o")


def evaluate(df: DataFrame, key: str, **fields: Field) -> DataFrame:
    """(key, name or name_channel ...) as FLOAT; strings stay strings."""
    cols = []
    for name, f in fields.items():
        for channel, col in f.columns.items():
            out = col if f.kind == "string" else col.cast("float")
            cols.append(out.alias(name if channel == "value" else f"{name}_{channel}"))
    return df.select(key, *cols)


def by_bfactor(stops: list, domain: tuple = (0, 100)) -> Field:
    return colormap(linear(attribute("bfactor"), domain), stops)


def by_element(colors: dict, fallback: tuple) -> Field:
    return categorical(attribute("element"), colors, fallback)


def by_sequence(stops: list, domain: tuple) -> Field:
    return colormap(linear(attribute("labelSeq", "atom", True, "residue"), domain), stops)


def by_chain(s: Structure, stops: list) -> Field:
    return colormap(Field("atom", "scalar", {"value": (F.pmod(F.col("chain"), F.lit(len(stops))) / F.lit(max(1, len(stops) - 1))).cast("double")}), stops)


def by_secondary_structure(helix, sheet, coil) -> Field:
    code = attribute("ssCode", "atom", True, "residue")
    return categorical(code, {1: helix, 4: helix, 5: helix, 2: sheet, 3: sheet}, coil)


def by_charge(stops: list, limit: float, name: str = "charge") -> Field:
    return colormap(linear(attribute(name), (-limit, limit)), stops)


def entity_keys(chains: DataFrame) -> DataFrame:
    """(entityId, key): ordinals in order of appearance. Entities are few by nature."""
    first = chains.groupBy("entityId").agg(F.min("chain").alias("c"))
    return first.select("entityId", (F.row_number().over(Window.orderBy("c")) - 1).alias("key"))


