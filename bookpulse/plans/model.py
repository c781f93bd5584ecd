"""A small semantic model: named dimensions and measures over related tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas as S


@dataclass(frozen=True)
class Dimension:
    table: str
    column: str
    comment: str = ""


@dataclass(frozen=True)
class Measure:
    """An aggregate that may be computed in two steps: ``kind`` is count, sum, min or max."""

    table: str
    kind: str
    column: str | None = None
    where: str | None = None
    digits: int | None = None
    comment: str = ""

    def partial(self) -> Column:
        value = F.col(self.column) if self.column else F.lit(1)
        if self.where:
            value = F.when(F.expr(self.where), value)
        return getattr(F, self.kind)(value)

    def final(self, partial: str) -> Column:
        merge = F.sum if self.kind in ("count", "sum") else getattr(F, self.kind)
        total = merge(partial)
        return total if self.digits is None else F.round(total, self.digits).cast("double")


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``fact`` refer to one row of ``dim`` by a key of the same name."""

    fact: str
    dim: str
    key: str


@dataclass(frozen=True)
class Model:
    dimensions: dict[str, Dimension]
    measures: dict[str, Measure]
    relationships: list[Relationship]
    default_filters: dict[str, str] = field(default_factory=dict)

    def describe(self, spark) -> DataFrame:
        rows = [("dimension", n, d.table, d.comment) for n, d in self.dimensions.items()]
        rows += [("measure", n, m.table, m.comment) for n, m in self.measures.items()]
        return spark.createDataFrame(rows, "kind string, name string, table string, comment string")


@dataclass(frozen=True)
class Between:
    """A range condition on a dimension; both ends belong to it, None leaves an end open."""

    low: object = None
    high: object = None


def _meets(column: Column, condition: list | Between) -> Column:
    if not isinstance(condition, Between):
        return column.isin(condition)
    test = column.isNotNull()
    if condition.low is not None:
        test &= column >= condition.low
    if condition.high is not None:
        test &= column <= condition.high
    return test


def query_model(
    model: Model,
    tables: dict[str, DataFrame],
    dims: list[str],
    measures: list[str],
    where: dict[str, list | Between] | None = None,
    order: list[Column] | None = None,
    limit: int | None = None,
    check_keys: bool = False,
) -> DataFrame:
    """Group the measures by the dimensions.

    ``where`` lists allowed values per dimension, or gives a range. With ``check_keys`` the declared
    relationships are checked first, and a repeated key raises instead of counting facts twice. Facts are aggregated by foreign key before they
    meet the dimension table, so the join handles one row per key whatever the skew of the fact.
    """
    chosen = {name: model.measures[name] for name in measures}
    bases = {m.table for m in chosen.values()}
    if len(bases) != 1:
        raise ValueError(f"measures must come from one table, not {sorted(bases)}")
    base = bases.pop()
    where = where or {}
    named = {n: d for n, d in model.dimensions.items() if n in dims or n in where}
    links = {r.dim: r for r in model.relationships if r.fact == base}
    far = {d.table for d in named.values()} - {base}
    if far - set(links):
        raise ValueError(f"no many-to-one path from {base} to {sorted(far - set(links))}")

    for t in far if check_keys else ():
        if not check_relationship(links[t], tables).isEmpty():
            raise ValueError(f"{links[t].key} is not unique in {t}")

    rows = tables[base]
    if base in model.default_filters:
        rows = rows.where(model.default_filters[base])
    near = {n: d for n, d in named.items() if d.table == base}
    for n in near.keys() & where.keys():
        rows = rows.where(_meets(F.col(near[n].column), where[n]))
    keys = {f"_key_{links[t].key}": F.col(links[t].key) for t in far}
    grouped = rows.groupBy(
        *[F.col(d.column).alias(n) for n, d in near.items() if n in dims],
        *[column.alias(alias) for alias, column in keys.items()],
    ).agg(*[m.partial().alias(f"_part_{n}") for n, m in chosen.items()])
    for t in far:
        key = links[t].key
        wanted = [F.col(d.column).alias(n) for n, d in named.items() if d.table == t]
        side = tables[t].select(F.col(key).alias(f"_key_{key}"), *wanted)
        grouped = grouped.join(side, f"_key_{key}", "left")
    for n in where.keys() - near.keys():
        grouped = grouped.where(_meets(F.col(n), where[n]))
    result = grouped.groupBy(*dims).agg(*[m.final(f"_part_{n}").alias(n) for n, m in chosen.items()])
    if order:
        result = result.orderBy(*order)
    return result.limit(limit) if limit is not None else result


def check_relationship(model_link: Relationship, tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once on the one-side; empty when the relationship holds."""
    return tables[model_link.dim].groupBy(model_link.key).count().where("count > 1")


def _dims(table: str, **comments: str) -> dict[str, Dimension]:
    return {name: Dimension(table, name, comment) for name, comment in comments.items()}


BOOK = Model(
    dimensions={
        **_dims(
            "positions",
            position_id="identifier of the position",
            issuer="borrower",
            sector="industry of the borrower",
            tranche="place in the capital structure",
            fund="vehicle that holds the position",
            current_rating="rating in the dimension",
            watchlist="true when on the watchlist",
            par_amount="face value",
            original_spread_bps="spread at origination",
            baseline_mark="opening mark per 100 of par",
        ),
        **_dims(
            "events",
            event_type="kind of event",
            side="direction of a trade",
            counterparty="other side of a trade",
            mark_source="where a mark came from",
            from_rating="rating before a credit event",
            to_rating="rating after a credit event",
            agency="who rated",
            source_app="application that sent the event",
            event_ts="time at the source",
            ingested_ts="time of arrival",
            qty="traded quantity",
            price="traded price",
            prev_mark="mark before",
            new_mark="mark after",
        ),
    },
    measures={
        "events": Measure("events", "count", comment="number of events"),
        "trades": Measure("events", "count", where=f"event_type = '{S.TRADE}'", comment="trades"),
        "traded_qty": Measure("events", "sum", "qty", digits=2, comment="quantity traded"),
        "last_event": Measure("events", "max", "event_ts", comment="newest event"),
        "par": Measure("positions", "sum", "par_amount", digits=2, comment="face value"),
        "positions": Measure("positions", "count", comment="number of positions"),
        "pnl": Measure("live", "sum", "pnl_today", digits=2, comment="P&L over the trailing day"),
    },
    relationships=[
        Relationship("events", "positions", "position_id"),
        Relationship("live", "positions", "position_id"),
    ],
    default_filters={"events": f"event_type != '{S.WARMUP}'"},
)
