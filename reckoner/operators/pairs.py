"""Labelled pairs: every matching (invoice, payment) pair, and for each invoice and each payment one
partner from outside its match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.functions.draws import draw_outside_range, u01
from reckoner.operators.ranks import dense_id, running_totals_dense
from reckoner.session import STORED, written_table

KINDS = ("match", "invoice_driven", "payment_driven")


def members(matches: DataFrame, ids: str, id_col: str) -> DataFrame:
    """Id lists of the match table to one row per (match, id)."""
    return matches.select("match_id", F.explode(ids).alias(id_col))


def indexed_members(long: DataFrame, id_col: str, index: str, every: DataFrame | None = None) -> DataFrame:
    """Members (with any further columns) numbered in the order (match, id). Given ``every`` id there is, ids without a match are numbered after all members, with a NULL
    match_id: they are partners that may be drawn.

    The members of a match take one unbroken range of numbers, so 'not in this match' is a range
    test and never a list. The numbered rows are a written table: later steps read it."""
    rows = long if every is None else every.select(id_col).join(long, id_col, "left").select(*long.columns)
    numbered = dense_id(rows.withColumn("_free", F.col("match_id").isNull()), ["_free", "match_id", id_col], index).drop("_free")
    return written_table(numbered, "members", STORED)


def member_ranges(indexed: DataFrame, index: str, prefix: str) -> DataFrame:
    """First number and size of each match's range."""
    return indexed.where(F.col("match_id").isNotNull()).groupBy("match_id").agg(
        F.min(index).alias(f"{prefix}_start"), F.count(F.lit(1)).alias(f"{prefix}_size"))


TILE = 256  # members of a match on each side of a tile


class PairPlan:
    """The three kinds of pairs of a set of matches.

    ``info`` has one row per match (match_id and carried columns); the members come from
    ``indexed_members`` with the numbers ``_inv_index`` and ``_pay_index``. A negative has the number of its partner, and one equi join
    on the number fetches it. The positives of a match are cut into tiles of TILE by TILE members: a member goes once to each
    tile of its row or column, and an equi join on the tile makes its pairs, so that a match of many by many is spread over tasks."""

    def __init__(self, info: DataFrame, invoices: DataFrame, payments: DataFrame, seed: int = 0,
                 limit: int | None = None, tile: int = TILE) -> None:
        self.seed, self.tile = seed, tile
        self.invoices = invoices.select("match_id", "invoice_id", "_inv_index")
        self.payments = payments.select("match_id", "payment_id", "_pay_index")
        self.carried = [c for c in info.columns if c != "match_id"]
        inv = member_ranges(self.invoices, "_inv_index", "inv")
        pay = member_ranges(self.payments, "_pay_index", "pay")
        i, p = F.col("inv_size"), F.col("pay_size")
        sizes = ("inv_start", "inv_size", "pay_start", "pay_size")
        # a match with an empty side has no positives, and negatives for the members of its other side
        per_match = (info.join(inv, "match_id", "left").join(pay, "match_id", "left")
                     .withColumns({c: F.coalesce(c, F.lit(0)) for c in sizes}).withColumn("pairs", i + i * p + p))
        matches = running_totals_dense(dense_id(per_match, ["match_id"], "_match"), "_match", ["pairs"]).drop("_slice", "_match")
        if limit is not None:
            matches = matches.where(F.col("pairs_before") < limit)
        # one slim row per match, read by both sides of ``rows``: written instead of computed twice
        self.matches = written_table(matches, "match-ranges", STORED)
        self.limited_invoices, self.limited_payments = self.invoices, self.payments
        if limit is not None:  # members are numbered in match order: those of the first matches are a prefix of the written numbers, and later files are not read
            ends = self.matches.agg(F.max(F.col("inv_start") + i), F.max(F.col("pay_start") + p)).first()
            self.limited_invoices = self.invoices.where(F.col("_inv_index") < F.lit(ends[0] or 0))
            self.limited_payments = self.payments.where(F.col("_pay_index") < F.lit(ends[1] or 0))

    def rows(self, *kinds: str) -> DataFrame:
        """Pairs of the given kinds (all without arguments)."""
        made = {"match": self._positives, "invoice_driven": self._by_invoice, "payment_driven": self._by_payment}
        parts = [made[k]() for k in KINDS if k in (kinds or KINDS)]
        out = reduce(DataFrame.union, parts)
        hit = F.col("kind") == "match"
        return out.select("pair_id", F.when(hit, F.col("drawn_for")).alias("match_id"), "drawn_for",
                          hit.alias("rows_match"), "kind", *self.carried, "invoice_id", "payment_id")

    def _made(self, rows: DataFrame, kind: str, slot: Column) -> DataFrame:
        return rows.select((F.col("pairs_before") + slot).cast("bigint").alias("pair_id"), F.col("match_id").alias("drawn_for"), F.lit(kind).alias("kind"),
                           *self.carried, "invoice_id", "payment_id")

    def _positives(self) -> DataFrame:
        """Tiles (i, j) of a match: invoices of block i with payments of block j."""
        sizes = self.matches.where("inv_size > 0 and pay_size > 0")
        block = lambda c: F.floor(c / F.lit(self.tile)).cast("int")
        blocks = lambda size: F.explode(F.sequence(F.lit(0), block(F.col(size) - F.lit(1))))
        i, j = F.col("_inv_index") - F.col("inv_start"), F.col("_pay_index") - F.col("pay_start")
        # the side that is one block more often than not carries the columns of the match
        left = (self.limited_invoices.join(sizes.select("match_id", "inv_start", "pay_size"), "match_id")
                .select("match_id", "invoice_id", i.alias("_i"), block(i).alias("_tile_i"), blocks("pay_size").alias("_tile_j")))
        right = (self.limited_payments.join(sizes, "match_id")
                 .select("match_id", "payment_id", j.alias("_j"), block(j).alias("_tile_j"), "pay_size", "pairs_before", *self.carried, blocks("inv_size").alias("_tile_i")))
        return self._made(left.join(right, ["match_id", "_tile_i", "_tile_j"]), "match", F.col("_i") * (F.col("pay_size") + F.lit(1)) + F.lit(1) + F.col("_j"))

    def _by_invoice(self) -> DataFrame:
        n = self.payments.agg(F.count(F.lit(1))).scalar()
        rows = self.limited_invoices.join(self.matches, "match_id").withColumn("_n", n).where(F.col("pay_size") < F.col("_n"))
        drawn = draw_outside_range(F.col("_n"), F.col("pay_start"), F.col("pay_size"), u01(self.seed, "neg_inv", "invoice_id"))
        slot = (F.col("_inv_index") - F.col("inv_start")) * (F.col("pay_size") + F.lit(1))
        rows = rows.select("match_id", "invoice_id", *self.carried, "pairs_before", slot.alias("_slot"), drawn.cast("bigint").alias("_pay_index"))
        return self._made(rows.join(self.payments.select("_pay_index", "payment_id"), "_pay_index"), "invoice_driven", F.col("_slot"))

    def _by_payment(self) -> DataFrame:
        n = self.invoices.agg(F.count(F.lit(1))).scalar()
        rows = self.limited_payments.join(self.matches, "match_id").withColumn("_n", n).where(F.col("inv_size") < F.col("_n"))
        drawn = draw_outside_range(F.col("_n"), F.col("inv_start"), F.col("inv_size"), u01(self.seed, "neg_pay", "payment_id"))
        slot = F.col("inv_size") * (F.col("pay_size") + F.lit(1)) + F.col("_pay_index") - F.col("pay_start")
        rows = rows.select("match_id", "payment_id", *self.carried, "pairs_before", slot.alias("_slot"), drawn.cast("bigint").alias("_inv_index"))
        return self._made(rows.join(self.invoices.select("_inv_index", "invoice_id"), "_inv_index"), "payment_driven", F.col("_slot"))


def build_pairs(info: DataFrame, invoice_members: DataFrame, payment_members: DataFrame,
                seed: int = 0, limit: int | None = None, invoices: DataFrame | None = None, payments: DataFrame | None = None) -> DataFrame:
    """Pair table with a dense ``pair_id``: per match, each invoice's negative before its positives,
    then one negative per payment. ``limit`` ends between matches. Partners are drawn from all rows: pass the tables ``invoices`` and ``payments`` to
    draw from those that belong to no match as well.

    A match that holds every payment (invoice) has no outside partner: it gets no such negative."""
    inv = indexed_members(invoice_members.select("match_id", "invoice_id"), "invoice_id", "_inv_index", invoices)
    pay = indexed_members(payment_members.select("match_id", "payment_id"), "payment_id", "_pay_index", payments)
    return PairPlan(info, inv, pay, seed, limit).rows()


def attach_invoice(pairs: DataFrame, invoices: DataFrame, name: str = "source") -> DataFrame:
    """Attach the invoice row as a struct."""
    shown = [c for c in invoices.columns if c != "invoice_id"]
    return pairs.join(invoices.select("invoice_id", F.struct(*shown).alias(name)), "invoice_id")


def attach_payment(pairs: DataFrame, payments: DataFrame, name: str = "target") -> DataFrame:
    """Attach the payment row as a struct."""
    shown = [c for c in payments.columns if c != "payment_id"]
    return pairs.join(payments.select("payment_id", F.struct(*shown).alias(name)), "payment_id")
