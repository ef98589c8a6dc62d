"""Schema views of the invoice and payment tables: one table or member tables, two sets of names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.operators.keyed import with_key_values
from reckoner.operators.ranks import first_per_key
from reckoner.schema import SCHEMA_MODES, attributes, check_mode, member_tables
from reckoner.session import bucketed_table


def project_view(df: DataFrame, side: str) -> DataFrame:
    """Id and the attributes that the one-table views show, in catalogue order."""
    return df.select(f"{side}_id", *[a.name for a in attributes(side) if a.in_view])


def rename_view(df: DataFrame, side: str, mode: str) -> DataFrame:
    """Attribute names to the ``descriptive`` or ``opaque`` ones."""
    check_mode(mode, SCHEMA_MODES[:2], "naming")
    return df.withColumnsRenamed({a.name: getattr(a, mode) for a in attributes(side) if a.name in df.columns})


def single_table_view(df: DataFrame, side: str, mode: str) -> DataFrame:
    return rename_view(project_view(df, side), side, mode)


def strip_ids(df: DataFrame, side: str) -> DataFrame:
    """A row as it is shown: without its id column."""
    return df.drop(f"{side}_id")


def match_view(matches: DataFrame) -> DataFrame:
    return matches.select("match_id", "match_category", "perturbation_categories", "invoice_ids", "payment_ids")


def split_tables(df: DataFrame, side: str) -> dict[str, DataFrame]:
    """Vertical split into the member tables, under opaque names, one row per id."""
    return {
        table: df.select(f"{side}_id", *[F.col(a.name).alias(a.opaque) for a in members])
        for table, (members, _) in member_tables(side).items()
    }


SLOT = 100_000  # ids that share one copy of a member row


def dedupe_by_key(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """One row per primary key, whatever the number of its ids: ``id_col`` is the lowest one, the attributes are those of its row, ``n_ids`` counts them. The ids
    themselves are rows of ``member_ids``. Only minima and counts are aggregated."""
    rest = [c for c in df.columns if c not in keys and c != id_col]
    least = [F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_ids")]
    if rest:
        least.append(F.min_by(F.struct(*rest), id_col).alias("_first"))
    out = df.groupBy(*keys).agg(*least)
    return out.select(id_col, *[F.col("_first")[c].alias(c) if c in rest else F.col(c) for c in df.columns if c != id_col], "n_ids")


def merged_by_key(df: DataFrame, keys: Sequence[str], id_col: str, chunk: int = 10_000) -> DataFrame:
    """The rows of ``dedupe_by_key`` with all their ids: ``id_col`` is a sorted list, and ``n_ids`` counts the ids of the key.

    A key with more than ``chunk`` ids takes several rows (``part`` 0, 1, ...), each with a share of its ids that their digests deal, so that a key with a third
    of the table is never one list. Only such keys are joined; the others meet their ids in the one aggregation."""
    rest = [c for c in df.columns if c not in keys and c != id_col]
    large = dedupe_by_key(df, keys, id_col).where(F.col("n_ids") > chunk)
    slim = large.select(*keys, F.col("n_ids").alias("_n"), *([F.struct(*rest).alias("_head")] if rest else []))
    spread = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 13), 16, 10).cast("bigint")
    part = F.pmod(spread, F.ceil(F.col("_n") / F.lit(float(chunk)))).cast("int")
    rows = with_key_values(df, slim, keys, "left").withColumn("part", F.coalesce(part, F.lit(0)))
    found = [F.sort_array(F.collect_list(id_col)).alias(id_col), F.coalesce(F.max("_n"), F.count(F.lit(1))).alias("n_ids")]
    if rest:
        found.append(F.coalesce(F.any_value("_head", True), F.min_by(F.struct(*rest), id_col)).alias("_first"))
    out = rows.groupBy(*keys, "part").agg(*found)
    return out.select(id_col, *[F.col("_first")[c].alias(c) if c in rest else F.col(c) for c in df.columns if c != id_col], "part", "n_ids")


def member_ids(df: DataFrame, keys: Sequence[str], id_col: str, name: str = "head") -> DataFrame:
    """The (key, id) relation in long form: ``df`` with ``name``, the id that the merged row of its key bears, and ``n_ids``. NULL is a key like any other."""
    heads = df.groupBy(*keys).agg(F.min(id_col).alias(name), F.count(F.lit(1)).alias("n_ids"))
    return with_key_values(df, heads, keys)


def _slots(n_ids: Column) -> Column:
    return F.ceil(n_ids / F.lit(float(SLOT))).cast("int")


@dataclass(frozen=True)
class Members:
    """The member tables of a side: ``rows`` with one row per primary key, and ``links`` with one row per id that names, for each table, the id its merged row bears
    (column of the table's name) and the copy to read (``<table>_slot``).

    A key with many ids counts as one copy of its row per SLOT ids, so that the ids of a key with a third of all rows meet their row in many tasks."""
    side: str
    rows: dict[str, DataFrame]
    links: DataFrame
    stored: dict[str, DataFrame]

    @property
    def id_col(self) -> str:
        return f"{self.side}_id"

    def written(self) -> "Members":
        """Links bucketed by id, copies of rows bucketed by key: written once, joined any number of times without another shuffle of them."""
        return Members(self.side, self.rows, bucketed_table(self.links, f"{self.side}_links", self.id_col), {
            t: bucketed_table(df, "member_" + t.replace("-", "_"), "_head", "_slot") for t, df in self.stored.items()})

    def attached(self, rows: DataFrame, tables: Sequence[str]) -> DataFrame:
        """``rows`` (with the id) and the row of each member table as a struct ``_<table>``. Ids without links drop out."""
        named = [c for t in tables for c in (t, f"{t}_slot")]
        out = rows.join(self.links.select(self.id_col, *[F.col(f"`{c}`") for c in named]), self.id_col)
        for t in tables:
            shown = [c for c in self.stored[t].columns if c not in ("_head", "_slot", self.id_col, "n_ids")]
            copies = self.stored[t].select("_head", "_slot", F.struct(*[F.col(f"`{c}`") for c in shown]).alias(f"_{t}"))
            out = out.join(copies, (F.col(f"`{t}`") == copies["_head"]) & (F.col(f"`{t}_slot`") == copies["_slot"])).drop("_head", "_slot", t, f"{t}_slot")
        return out


def normalise(df: DataFrame, side: str) -> dict[str, DataFrame]:
    """Member tables with one row per primary key."""
    tables = split_tables(df, side)
    return {table: dedupe_by_key(tables[table], [a.opaque for a in key], f"{side}_id") for table, (_, key) in member_tables(side).items()}


def members(df: DataFrame, side: str) -> Members:
    """Member tables and the links of ids to them. Tables with the same primary key share the aggregation that finds the ids of their rows."""
    id_col, rows = f"{side}_id", normalise(df, side)
    keys = {table: tuple(a.opaque for a in key) for table, (_, key) in member_tables(side).items()}
    names = {a.name: a.opaque for a in attributes(side) if any(a.opaque in k for k in keys.values())}
    out, done = df.select(id_col, *[F.col(n).alias(o) for n, o in names.items()]), {}
    for table, key in keys.items():
        if key not in done:
            done[key] = table
            out = member_ids(out, key, id_col, table)
            out = out.withColumn(f"{table}_slot", F.pmod(F.xxhash64(id_col), _slots(F.col("n_ids"))).cast("int")).drop("n_ids")
    linked = [F.col(f"`{done[keys[t]]}{end}`").alias(f"{t}{end}") for t in keys for end in ("", "_slot")]
    copies = {t: r.withColumn("_head", F.col(id_col)).withColumn("_slot", F.explode(F.sequence(F.lit(0), _slots(F.col("n_ids")) - F.lit(1)))) for t, r in rows.items()}
    return Members(side, rows, out.select(id_col, *linked), copies)


def join_on_member(rows: DataFrame, side: Members, table: str) -> DataFrame:
    """``rows`` (with the id) and the columns of the member row they belong to."""
    out = side.attached(rows, [table])
    return out.select(*rows.columns, f"`_{table}`.*")


def reassemble_source(rows: DataFrame, side: Members) -> DataFrame:
    """Attach header, item and customer of each invoice in ``rows`` (column ``invoice_id``) as structs."""
    out = side.attached(rows, ["BKPF", "BSEG", "KNA-1"])
    return out.withColumnsRenamed({"_BKPF": "BKPF", "_BSEG": "BSEG"}).withColumn("KNA", F.struct(*[F.col("`_KNA-1`")[c].alias(c) for c in ("MANDT", "KUNNR", "NAME1")])).drop("_KNA-1")


CUSTOMERS = 1000  # customers in a block


def all_customers(rows: DataFrame, kna: DataFrame, block: int = CUSTOMERS) -> DataFrame:
    """Option: the whole customer table for every row, in blocks of about ``block`` customers. A row comes once per block (``block``, from 0), with the block's customers in
    order as an array ``KNA``; the customers of all blocks of a row are the whole table. The blocks are dealt by digest, and each (row, block) is one equi join partner."""
    one_each = first_per_key(kna.select("MANDT", "KUNNR", "NAME1", "invoice_id"), ["MANDT", "KUNNR"], "invoice_id")
    n = one_each.agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int"))
    dealt = one_each.withColumn("_n", n.scalar()).withColumn("block", F.pmod(F.xxhash64("MANDT", "KUNNR"), F.col("_n")).cast("int"))
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("MANDT", "KUNNR", "NAME1"))).alias("KNA"))
    every = rows.withColumn("_n", n.scalar()).where("_n > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_n") - F.lit(1)))).drop("_n")
    return every.join(blocks, "block")


def schema_views(invoices: DataFrame, payments: DataFrame, matches: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """Every view of one perturbation mode by (schema mode, table name). The multi-table view has a table ``<side>s_links`` besides: for each id, the id that its row of each
    member table bears."""
    views: dict[tuple[str, str], DataFrame] = {}
    for mode in SCHEMA_MODES[:2]:
        views[mode, "invoices"] = single_table_view(invoices, "invoice", mode)
        views[mode, "payments"] = single_table_view(payments, "payment", mode)
    for side, df in (("invoice", invoices), ("payment", payments)):
        parts = members(df, side)
        for table, rows in parts.rows.items():
            views["multi-table", f"{side}s_{table}"] = rows
        views["multi-table", f"{side}s_links"] = parts.links.select(f"{side}_id", *[F.col(f"`{t}`") for t in parts.rows])
    for mode in SCHEMA_MODES:
        views[mode, "matches"] = match_view(matches)
    return views
