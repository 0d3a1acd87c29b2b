"""Sales lines over a star schema: line items with order, customer, nation, part and supplier."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.fixed_values import SIZES
from tillwright.functions import text
from tillwright.operators.cleaning import MEASURES, add_derived, add_measures, clean_roles
from tillwright.operators.filters import EVERY, FilterSpec, row_class
from tillwright.schema import DERIVED_FROM, PLACE, RAW_TYPES, STAR_SCHEMA

# Table columns each role is computed from.
INPUTS: dict[str, tuple[str, ...]] = {
    "order_id": ("l_orderkey",),
    "order_key": ("l_orderkey",),
    "date": ("o_date",),
    "status": ("l_returnflag", "o_status"),
    "fulfilment": ("l_linestatus",),
    "service_level": ("o_service_level",),
    "style": ("p_style",),
    "sku": ("l_partkey",),
    "category": ("p_category",),
    "size": ("p_size",),
    "courier_status": ("l_courier_status",),
    "qty": ("l_qty",),
    "amount": ("l_amount",),
    "city": ("s_city",),
    "state": ("n_state",),
    "promotion_ids": ("l_promotion_ids",),
    "b2b": ("c_b2b",),
    "kind": ("kind",),
}


@dataclass(frozen=True)
class Dimension:
    """A table joined by ``key`` of the lines so far to its own unique ``own_key``."""

    table: str
    key: str
    own_key: str
    gives: tuple[str, ...]


# In join order: a dimension's key comes from the line items or from an earlier dimension.
DIMENSIONS = (
    Dimension("orders", "l_orderkey", "o_orderkey", ("o_date", "o_status", "o_service_level", "o_custkey")),
    Dimension("customer", "o_custkey", "c_custkey", ("c_b2b", "c_nationkey")),
    Dimension("nation", "c_nationkey", "n_nationkey", ("n_state",)),
    Dimension("part", "l_partkey", "p_partkey", ("p_style", "p_category", "p_size")),
    Dimension("supplier", "l_citykey", "s_suppkey", ("s_city",)),
)


# How derived table columns are computed; the others are read as they are.
COLUMNS: dict[str, str] = {
    "l_qty": "CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INT) END",
    "l_amount": "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END",
    "l_courier_status": """CASE WHEN l_linenumber = 6 THEN NULL WHEN l_returnflag = 'R' THEN 'Cancelled'
        ELSE 'Shipped' END""",
    "l_promotion_ids": "CASE WHEN l_discount = 0 THEN NULL ELSE 'PROMO' END",
    # Lines without a city simply have no supplier to look it up from.
    "l_citykey": "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_suppkey END",
    "o_date": "CAST(o_orderdate AS DATE)",
    "o_status": "o_orderstatus",
    "o_service_level": "o_orderpriority",
    "c_b2b": "c_mktsegment = 'MACHINERY'",
    "n_state": """CASE n_nationkey WHEN 24 THEN NULL WHEN 0 THEN ' rj ' WHEN 1 THEN 'Rajsthan' WHEN 2 THEN 'RAJASTHAN'
        WHEN 3 THEN 'APO' ELSE lower(n_name) END""",
    "p_style": "p_brand",
    "p_category": "p_type",
    "s_city": "s_name",
}

# Place names are tidied in the dimension, once per nation or supplier instead of once per line.
TIDY_COLUMNS = {**COLUMNS, "n_state": text.state(f"({COLUMNS['n_state']})"), "s_city": text.place(COLUMNS["s_city"])}

# How roles are computed once the tables are joined; the others equal their input.
ROLES: dict[str, str] = {
    "order_id": "CAST(l_orderkey AS STRING)",
    "sku": "CAST(l_partkey AS STRING)",
    "size": f"CASE p_size % 12 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SIZES))} ELSE 'Other' END",
    "fulfilment": "CASE WHEN l_linestatus = 'F' THEN 'Amazon' ELSE 'Merchant' END",
    "status": """CASE WHEN l_returnflag = 'R' AND o_status = 'F' THEN 'Cancelled' WHEN o_status = 'P' THEN 'Pending'
        WHEN l_returnflag = 'A' THEN 'Shipped - Delivered to Buyer' ELSE 'Shipped' END""",
}


_HOME = {column: d.table for d in DIMENSIONS for column in d.gives}


def _digest(rules: Sequence[str], name: str) -> list[str]:
    """Two 64-bit digests of some columns, which tell nulls from their places."""
    parts = "".join(f", isnull({rule}), {rule}" for rule in rules)
    return [f"xxhash64({n}{parts}) AS {name}_{n}" for n in (1, 2)]


def _nothing(rules: Sequence[str], name: str) -> list[tuple[str, str]]:
    """The names of the two digests, and what they are of nulls alone, which a hash passes over."""
    return [(f"{name}_{n}", f"xxhash64({n}{', true' * len(rules)})") for n in (1, 2)]


def _named(names: Iterable[str], rules: Mapping[str, str]) -> list[str]:
    return [f"{rules[n]} AS {n}" if n in rules else n for n in names]


@dataclass(frozen=True)
class StarSales:
    """Reads only the tables and columns the asked-for roles come from.

    Dimensions are joined on their unique keys with left joins: every line appears exactly once
    however many of them take part, so a dimension nobody asks for need not be read at all.
    """

    spark: SparkSession
    path: str
    filters: FilterSpec = FilterSpec()
    opened: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def where(self, spec: FilterSpec) -> StarSales:
        return replace(self, filters=spec)

    def lines(self, *roles: str, rows: str = EVERY) -> DataFrame:
        """Roles plus measures, filtered: one row per line."""
        return self._clean(roles, rows, summed=False)

    def totals(self, *roles: str, rows: str = EVERY) -> DataFrame:
        """Roles plus measures, filtered, summed by the join key before every join that allows it.

        Several rows may agree on all roles and a row may stand for many lines, so measures can be
        added up and nothing else. No key, however hot, is more than one row in such a join.
        """
        return self._clean(roles, rows, summed=True)

    def _clean(self, roles: Sequence[str], rows: str, summed: bool) -> DataFrame:
        base = [DERIVED_FROM.get(r, r) for r in [*roles, *sorted(self.filters.roles())] if r not in MEASURES]
        inputs = ("l_orderkey AS order_id", "l_qty AS qty", "l_amount AS amount")
        items = add_measures(self._items().selectExpr("*", *inputs))
        wanted = row_class(rows)
        items = items if wanted is None else items.where(wanted)
        joined = self._join(items, list(dict.fromkeys(base)), MEASURES, TIDY_COLUMNS, summed)
        clean = add_derived(clean_roles(joined, tidy_places=True))
        return self.filters.apply(clean).select(*dict.fromkeys([*roles, *MEASURES]))

    def raw(self, *roles: str, placed: bool = False) -> DataFrame:
        """The raw line view, one row per line, with the columns of ``STAR_SCHEMA``; filters do not apply.

        With ``placed``, column ``PLACE`` orders the lines as in ``weighted_raw``.
        """
        wanted = list(roles or RAW_TYPES)
        if placed:
            return self.weighted_raw(*wanted, placed=True).drop("lines").withColumnRenamed("place", PLACE)
        return self._raw_named(self._join(self._items(), wanted, ()), wanted)

    def weighted_raw(self, *roles: str, placed: bool = False) -> DataFrame:
        """Raw columns of some roles with the number of ``lines`` each row stands for.

        With ``placed``, column ``place`` orders the lines, by order and line number, those without an
        order last.
        """
        items = self._items().withColumn("lines", F.lit(1).cast("long"))
        items = items.withColumn("place", F.struct(F.col("l_orderkey").isNull(), F.coalesce("l_orderkey", F.lit(0)), "l_linenumber"))
        more = ("lines", "place") if placed else ("lines",)
        return self._raw_named(self._join(items, roles, more), roles, *more)

    def raw_parts(self, placed: bool = False) -> list[DataFrame]:
        """The raw columns grouped by the table that is joined last to get them, weighted by ``lines``.

        Column-wise audits run on each group by itself, so none of them carries all columns through
        all joins.
        """
        last = {column: d.table for d in DIMENSIONS for column in d.gives}
        last["n_state"] = last["c_b2b"]
        groups: dict[str, list[str]] = {}
        for role in RAW_TYPES:
            groups.setdefault(last.get(INPUTS[role][-1], "lineitem"), []).append(role)
        return [self.weighted_raw(*group, placed=placed) for group in groups.values()]

    def row_digests(self) -> DataFrame:
        """128 bits of each raw line's columns, as d1 and d2, over all joins: no key is taken to be unique.

        What a table alone gives is digested there, so that joins and shuffles carry keys and digests and
        none of the texts. A line without a match has nulls, and so has a match of nulls alone: their
        digests are alike.
        """
        of_table: dict[str, list[str]] = {}
        for role in RAW_TYPES:
            homes = {_HOME.get(column, "lineitem") for column in INPUTS[role]}
            of_table.setdefault(homes.pop() if len(homes) == 1 else "", []).append(ROLES.get(role, INPUTS[role][0]))
        # A line without a city has a supplier all the same, who may repeat.
        key_of = {d.table: "l_suppkey" if d.key == "l_citykey" else d.key for d in DIMENSIONS}
        mixed = of_table.pop("")
        kept = dict.fromkeys([*(k for k in key_of.values() if k.startswith("l_")), "l_returnflag", "l_linenumber"])
        df = self._items().selectExpr(*kept, *_digest(of_table["lineitem"], "lineitem"))
        digests = ["lineitem"]
        for dimension in DIMENSIONS:
            own = of_table.get(dimension.table, [])
            onward = [c for c in dimension.gives if c in {d.key for d in DIMENSIONS} or c == "o_status"]
            side = self._table(dimension.table).selectExpr(dimension.own_key, *_named(dimension.gives, COLUMNS))
            side = side.selectExpr(dimension.own_key, *onward, *_digest(own, dimension.table))
            joined = df.join(side, F.col(key_of[dimension.table]) == F.col(dimension.own_key), "left")
            kept.pop(key_of[dimension.table], None)
            kept |= dict.fromkeys(onward)
            digests.append(dimension.table)
            known = "l_linenumber IS DISTINCT FROM 5" if dimension.key == "l_citykey" else "true"
            found = [f"CASE WHEN {known} THEN coalesce({name}, {nothing}) ELSE {nothing} END AS {name}" for name, nothing in _nothing(own, dimension.table)]
            earlier = [f"{table}_{n}" for table in digests[:-1] for n in (1, 2)]
            df = joined.selectExpr(*kept, *earlier, *found)
        whole = [", ".join([*(f"{table}_{n}" for table in digests), *(f"isnull({rule}), {rule}" for rule in mixed)]) for n in (1, 2)]
        return df.selectExpr(f"xxhash64({whole[0]}) AS d1", f"xxhash64({whole[1]}) AS d2")

    def order_ids(self) -> DataFrame:
        """The order ids of all raw lines, as the tables spell them."""
        return self._join(self._items(), ["order_key"], ())

    def raw_name(self, role: str) -> str:
        return STAR_SCHEMA.name(role)

    @staticmethod
    def _raw_named(df: DataFrame, roles: Sequence[str], *more: str) -> DataFrame:
        return df.selectExpr(*[f"{r} AS {STAR_SCHEMA.name(r)}" for r in roles], *more)

    def _table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self.opened[name]

    def _items(self) -> DataFrame:
        return self._table("lineitem").selectExpr("*", *_named([c for c in COLUMNS if c.startswith("l_")], COLUMNS))

    def _join(
        self,
        items: DataFrame,
        roles: Sequence[str],
        measures: Sequence[str],
        columns: Mapping[str, str] = COLUMNS,
        summed: bool = False,
    ) -> DataFrame:
        """Join the dimensions the roles need, dropping each column after its last use.

        With ``summed``, rows left with nothing but their key and additive measures are summed by
        that key before the join.
        """
        needed = {column for role in roles for column in INPUTS[role]}
        used: list[Dimension] = []
        for dimension in reversed(DIMENSIONS):
            if needed & set(dimension.gives):
                used.insert(0, dimension)
                needed.add(dimension.key)
        df = items.select(*[c for c in items.columns if c in needed], *measures)
        outputs = {column for role in roles for column in INPUTS[role]}
        for i, dimension in enumerate(used):
            gives = [c for c in dimension.gives if c in needed]
            side = self._table(dimension.table).selectExpr(dimension.own_key, *_named(gives, columns))
            if summed and set(df.columns) == {dimension.key, *measures}:
                df = df.groupBy(dimension.key).agg(*[F.sum(m).alias(m) for m in measures])
            keep = outputs | {later.key for later in used[i + 1 :]}
            df = df.join(side, F.col(dimension.key) == F.col(dimension.own_key), "left").select(
                *[c for c in [*df.columns, *gives] if c in keep or c in measures]
            )
        rules = {role: ROLES.get(role, INPUTS[role][0]) for role in roles}
        return df.selectExpr(*_named(roles, rules), *measures)
