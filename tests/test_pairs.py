"""Numbering, pairs, examples and views: brute force, partition independence, hot groups."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reckoner import queries
from reckoner.functions import draws, text
from reckoner.operators import pairs, perturb, ranks, requests, views
from reckoner.operators.joined import first_hit, split_group_total
from reckoner.sources import bridge
from tests.plans import up_to_join

FOLDER = "/root/testdata/sf0.001"


def match_fixture(spark):
    """Small matches, one with a third of all payments and one with a third of all invoices."""
    inv, pay, info = [], [], []
    i = p = 0
    for m in range(60):
        n_i, n_p = (40, 1) if m == 7 else (1, 40) if m == 11 else (1 + m % 3 // 2, 1) if m % 2 else (1, 1 + m % 4)
        for _ in range(n_i):
            inv.append((m * 10, i * 3)); i += 1  # noqa: E702
        for _ in range(n_p):
            pay.append((m * 10, p * 5)); p += 1  # noqa: E702
        info.append((m * 10, "c"))
    return (spark.createDataFrame(info, "match_id bigint, match_category string"),
            spark.createDataFrame(inv, "match_id bigint, invoice_id bigint"),
            spark.createDataFrame(pay, "match_id bigint, payment_id bigint"), inv, pay)


def test_pairs_against_brute_force(spark):
    info, inv_m, pay_m, inv, pay = match_fixture(spark)
    rows = pairs.build_pairs(info, inv_m, pay_m, 3).collect()
    owner_i, owner_p = {i: m for m, i in inv}, {p: m for m, p in pay}
    positives = {(i, p) for m, i in inv for n, p in pay if m == n}
    assert {(r.invoice_id, r.payment_id) for r in rows if r.kind == "match"} == positives
    for r in rows:
        own = owner_i[r.invoice_id] == owner_p[r.payment_id]
        assert own == r.rows_match == (r.kind == "match")
        driver = owner_i[r.invoice_id] if r.kind == "invoice_driven" else owner_p[r.payment_id]
        assert driver == r.drawn_for and (r.match_id == driver if own else r.match_id is None)
    assert Counter(r.invoice_id for r in rows if r.kind == "invoice_driven") == Counter(i for _, i in inv)
    assert Counter(r.payment_id for r in rows if r.kind == "payment_driven") == Counter(p for _, p in pay)
    assert sorted(r.pair_id for r in rows) == list(range(len(rows)))
    per_match = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.pair_id):
        per_match[r.drawn_for].append(r)
    assert list(per_match) == sorted(per_match)
    for group in per_match.values():  # each invoice: its negative, its positives; then the payments' negatives
        kinds = [r.kind for r in group]
        n_i, n_p = kinds.count("invoice_driven"), kinds.count("payment_driven")
        assert kinds == (["invoice_driven"] + ["match"] * n_p) * n_i + ["payment_driven"] * n_p


def test_limit_ends_between_matches(spark):
    info, inv_m, pay_m, *_ = match_fixture(spark)
    rows = pairs.build_pairs(info, inv_m, pay_m, 3).collect()
    limited = pairs.build_pairs(info, inv_m, pay_m, 3, limit=30).collect()
    kept = {r.drawn_for for r in rows if r.pair_id < 30}
    assert {r.pair_id for r in limited} == {r.pair_id for r in rows if r.drawn_for in kept} and len(limited) > 30
    assert {tuple(r) for r in limited} <= {tuple(r) for r in rows}


def test_a_limit_reads_a_prefix_of_the_members(spark):
    info, inv_m, pay_m, *_ = match_fixture(spark)
    im, pm = pairs.indexed_members(inv_m, "invoice_id", "_inv_index"), pairs.indexed_members(pay_m, "payment_id", "_pay_index")
    plan = pairs.PairPlan(info, im, pm, 3, limit=30).rows("match")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(_inv_index," in plan and "LessThan(_pay_index," in plan
    assert "LessThan(_inv_index," not in pairs.PairPlan(info, im, pm, 3).rows("match")._jdf.queryExecution().executedPlan().toString()


def test_a_match_with_every_payment_has_no_negative_for_it(spark):
    info = spark.createDataFrame([(1, "c")], "match_id bigint, match_category string")
    inv = spark.createDataFrame([(1, 5)], "match_id bigint, invoice_id bigint")
    pay = spark.createDataFrame([(1, 8), (1, 9)], "match_id bigint, payment_id bigint")
    assert {r.kind for r in pairs.build_pairs(info, inv, pay).collect()} == {"match"}


def test_results_do_not_depend_on_partitions(spark):
    info, inv_m, pay_m, *_ = match_fixture(spark)
    texts = spark.range(200).select(F.col("id").alias("pair_id"), (F.col("id") % 3 == 0).alias("rows_match"),
                                    F.concat(F.lit("a"), "id").alias("first_table_row"),
                                    F.concat(F.lit("b"), "id").alias("second_table_row"))
    cfg = requests.RequestConfig(model="m", num_examples=2, draw_seed=1)
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            made = pairs.build_pairs(info.repartition(n), inv_m.repartition(n), pay_m.repartition(n), 3).collect()
            chats = requests.build_requests(texts.repartition(n), cfg).collect()
            seen.add((repr(sorted(map(repr, made))), repr(sorted(map(repr, chats)))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_examples_exclude_the_row_and_hold_both_labels(spark):
    texts = spark.range(50).select(F.col("id").alias("pair_id"), (F.col("id") % 4 == 0).alias("rows_match"),
                                   F.col("id").cast("string").alias("first_table_row"), F.lit("b").alias("second_table_row"))
    rows = requests.attach_examples(texts, 3, 5).collect()
    assert len(rows) == 50
    orders = set()
    for r in rows:
        ids = [int(e.first_table_row) for e in r.examples]
        assert len(set(ids)) == 6 and r.pair_id not in ids
        assert sorted(e.ground_truth for e in r.examples) == ["No"] * 3 + ["Yes"] * 3
        assert all((i % 4 == 0) == (e.ground_truth == "Yes") for i, e in zip(ids, r.examples))
        orders.add(tuple(e.ground_truth for e in r.examples))
    assert len(orders) > 5
    with pytest.raises(Exception, match="fewer than 13"):
        requests.attach_examples(texts, 13, 5).collect()


def test_dense_ids_of_sparse_clustered_keys(spark):
    keys = [i for i in range(1000)] + [10**15 + i * i for i in range(300)] + [-5]
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k bigint, w bigint").repartition(7)
    assert {r.k: r["index"] for r in ranks.dense_id(df, ["k"]).collect()} == {k: i for i, k in enumerate(sorted(keys))}
    total, want = 0, {}
    for k in sorted(keys):
        want[k], total = total, total + k % 3
    assert {r.k: r.before for r in ranks.running_total(df, ["k"], "w").collect()} == want


def test_a_key_of_any_size_is_one_row_and_its_ids_are_rows(spark, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("g"), "id", F.lit("x").alias("c"))
    rows = {r.g: r for r in views.dedupe_by_key(df, ["g"], "id").collect()}
    assert len(rows) == 601 and (rows[0].id, rows[0].n_ids) == (0, 400) and all(r.id == g and r.n_ids == 1 for g, r in rows.items() if g)
    heads = {r.id: r["head"] for r in views.member_ids(df, ["g"], "id").collect()}
    assert heads == {i: 0 if i < 400 else i for i in range(1000)}
    # the ids of a large key meet copies of its row: about SLOT of them each
    monkeypatch.setattr(views, "SLOT", 20)
    inv = bridge.invoices(spark, FOLDER).withColumn("inv_customer_id", F.when(F.col("invoice_id") % 3 == 0, "hot").otherwise(F.col("inv_customer_id")))
    side = views.members(inv, "invoice")
    hot = side.links.join(inv.select("invoice_id", "inv_customer_id"), "invoice_id").where("inv_customer_id = 'hot'")
    per_copy = [r["count"] for r in hot.groupBy("`KNA-1_slot`").count().collect()]
    assert sum(per_copy) == 500 and len(per_copy) == 25 and max(per_copy) < 45
    seen = {r.invoice_id: r.KUNNR for r in views.join_on_member(inv.select("invoice_id"), side, "KNA-1").collect()}
    assert seen == {r.invoice_id: r.inv_customer_id for r in inv.collect()}


def test_written_members_are_not_shuffled_again(spark):
    side = views.members(bridge.invoices(spark, FOLDER), "invoice").written()
    rows = bridge.invoices(spark, FOLDER).select("invoice_id").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        above = up_to_join(views.reassemble_source(rows, side), "FileScan parquet spark_catalog")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(above) == 4 and all("Exchange" not in names and names[-1].endswith("Join") for names in above), above
    assert sorted(views.reassemble_source(rows, side).select("invoice_id").collect()) == sorted(rows.collect())


def test_partners_are_drawn_from_rows_of_no_match_too(spark):
    info, inv_m, pay_m, inv, pay = match_fixture(spark)
    every_i = spark.createDataFrame([(i,) for _, i in inv] + [(10**6 + k,) for k in range(200)], "invoice_id bigint")
    every_p = spark.createDataFrame([(p,) for _, p in pay] + [(10**6 + k,) for k in range(200)], "payment_id bigint")
    rows = pairs.build_pairs(info, inv_m, pay_m, 3, invoices=every_i, payments=every_p).collect()
    open_p = [r.payment_id for r in rows if r.kind == "invoice_driven" and r.payment_id >= 10**6]
    open_i = [r.invoice_id for r in rows if r.kind == "payment_driven" and r.invoice_id >= 10**6]
    assert len(set(open_p)) > 20 and len(set(open_i)) > 20
    assert Counter(r.invoice_id for r in rows if r.kind == "invoice_driven") == Counter(i for _, i in inv)
    assert sorted(r.pair_id for r in rows) == list(range(len(rows)))
    plain = {(r.invoice_id, r.payment_id, r.pair_id) for r in pairs.build_pairs(info, inv_m, pay_m, 3).collect() if r.kind == "match"}
    assert plain == {(r.invoice_id, r.payment_id, r.pair_id) for r in rows if r.kind == "match"}


def test_matches_of_many_by_many_are_spread_in_tiles(spark):
    sizes = [(1, 600, 500), (2, 1, 1), (3, 7, 0), (4, 0, 5), (5, 16, 16), (6, 17, 1), (7, 1, 300)]
    info = spark.createDataFrame([(m,) for m, *_ in sizes], "match_id bigint")
    inv = [(m, m * 10_000 + k) for m, n, _ in sizes for k in range(n)]
    pay = [(m, m * 10_000 + k) for m, _, n in sizes for k in range(n)]
    im = pairs.indexed_members(spark.createDataFrame(inv, "match_id bigint, invoice_id bigint"), "invoice_id", "_inv_index")
    pm = pairs.indexed_members(spark.createDataFrame(pay, "match_id bigint, payment_id bigint"), "payment_id", "_pay_index")
    rows = pairs.PairPlan(info, im, pm, 3, tile=16).rows("match", "invoice_driven", "payment_driven")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hits = rows.where("kind = 'match'")
        per_task = [r["count"] for r in hits.groupBy(F.spark_partition_id().alias("t")).count().collect()]
        found = rows.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(per_task) < 2 * sum(per_task) / 16
    want, at = set(), 0
    for m, n_i, n_p in sizes:
        want |= {(at + i * (n_p + 1) + 1 + j, m * 10_000 + i, m * 10_000 + j) for i in range(n_i) for j in range(n_p)}
        at += n_i + n_i * n_p + n_p
    assert {(r.pair_id, r.invoice_id, r.payment_id) for r in found if r.kind == "match"} == want
    assert sorted(r.pair_id for r in found) == list(range(at))


def test_group_totals_split_exactly(spark):
    df = spark.range(900).select(
        F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 50).alias("g"), "id",
        (F.col("id") % 17).cast("decimal(25,2)").alias("w"), F.lit("1000.03").cast("decimal(15,2)").alias("t"))
    out = split_group_total(df.where("w > 0"), "g", "t", "w", "id", "part").groupBy("g").agg(
        F.sum("part").alias("s"), F.min("part").alias("m")).collect()
    assert all(str(r.s) == "1000.03" and r.m >= 0 for r in out)


def test_member_tables_join_back_to_the_opaque_view(spark):
    inv = bridge.invoices(spark, FOLDER)
    rows = inv.select("invoice_id")
    back = views.reassemble_source(rows, views.members(inv, "invoice")).select(
        "invoice_id", "BKPF.MANDT", "BKPF.BURKS", "BKPF.GJAHR", "BKPF.BELNR", "BSEG.BZUEI", "BSEG.ZUONR", "BSEG.VBELN",
        "BSEG.KUNNR", "KNA.NAME1", "BKPF.WAERS", "BSEG.WRBTR", "BKPF.BLDAT", "BSEG.ZFBDT")
    opaque = views.single_table_view(inv, "invoice", "opaque")
    assert back.columns == opaque.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, opaque.collect()))


def test_all_customers_come_in_blocks(spark):
    t = views.normalise(bridge.invoices(spark, FOLDER), "invoice")
    got = views.all_customers(spark.range(2), t["KNA-1"], 40).collect()
    shown = {i: sorted(tuple(c) for r in got if r.id == i for c in r.KNA) for i in (0, 1)}
    assert len(got) > 4 and max(len(r.KNA) for r in got) < 80 and shown[0] == shown[1] and len(set(shown[0])) == 150
    assert views.all_customers(spark.range(2), t["KNA-1"].limit(0)).collect() == []


def test_first_hit_never_multiplies_and_raises_if_absent(spark):
    names = spark.createDataFrame([("A", 3, "late"), ("A", 1, "first"), ("B", 2, "b")], "name string, pos int, stmt string")
    df = spark.createDataFrame([("A",), ("B",), ("A",)], "name string")
    assert sorted(r.stmt for r in first_hit(df, names, "name", "pos", "stmt").collect()) == ["b", "first", "first"]
    with pytest.raises(Exception, match="no stmt for name Z"):
        first_hit(spark.createDataFrame([("Z",)], "name string"), names, "name", "pos", "stmt").collect()


def test_perturbed_rows_differ_only_where_marked(spark):
    spec = [perturb.Perturbation("a", "x", lambda c, s, t, k: F.concat(c, F.lit("!"))),
            perturb.Perturbation("b", "y", lambda c, s, t, k: text.break_identifier(c, s, t, k), 3.0)]
    df = spark.range(4000).select("id", F.lit("left").alias("x"), F.lit("1234567").alias("y"))
    for mode in ("single", "multi"):
        rows = perturb.perturb(df, spec, "id", mode, 0.75, 2).collect()
        assert all((r.x != "left") == ("a" in r.perturbation_categories) for r in rows)
        assert all(r.y == "1234567" for r in rows if "b" not in r.perturbation_categories)
        share = sum(bool(r.perturbation_categories) for r in rows) / len(rows)
        assert share == pytest.approx(0.75, abs=0.03)
        most = max(len(r.perturbation_categories) for r in rows)
        assert most == (1 if mode == "single" else 2)
    with pytest.raises(ValueError, match="perturbation mode"):
        perturb.perturb(df, spec, "id", "other")


def test_draw_laws(spark):
    df = spark.range(20000)
    row = df.select(
        F.avg(draws.beta(2, 10, 1, "b", "id")).alias("beta"), F.avg(draws.u01(1, "u", "id")).alias("u"),
        F.avg((draws.exp_drop([1, 2, 3, 4], 4, draws.u01(1, "e", "id")) == 1).cast("int")).alias("drop")).first()
    assert row.beta == pytest.approx(2 / 12, abs=0.005) and row.u == pytest.approx(0.5, abs=0.01)
    assert row["drop"] == pytest.approx(1 / (1 + 1 / 4 + 1 / 16 + 1 / 64), abs=0.01)
    big = 3 * 10**9  # the DECIMAL path
    ranks_of = df.select(draws.permuted(F.col("id"), 20000, 9).alias("a"), draws.permuted(F.col("id"), big, 9).alias("b"),
                         draws.permuted(F.col("id"), F.lit(20000), 9).alias("c")).collect()
    assert sorted(r.a for r in ranks_of) == list(range(20000)) and all(r.a == r.c for r in ranks_of)
    assert len({r.b for r in ranks_of}) == 20000 and all(0 <= r.b < big for r in ranks_of)


def test_pair_requests_deal_the_texts_once(spark):
    """The same chats as from rows that carry their texts, and one exchange of the texts by pair_id that both joins read."""
    pairs_ = spark.range(40).select(F.col("id").alias("pair_id"), (F.col("id") % 3 == 0).alias("rows_match"), (F.col("id") % 7).alias("invoice_id"), (F.col("id") % 5).alias("payment_id"))
    one = spark.range(7).select(F.col("id").alias("invoice_id"), F.concat(F.lit("invoice "), F.col("id").cast("string")).alias("first_table_row"))
    two = spark.range(5).select(F.col("id").alias("payment_id"), F.concat(F.lit("payment "), F.col("id").cast("string")).alias("second_table_row"))
    cfg = requests.RequestConfig(model="m", num_examples=2, draw_seed=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = requests.pair_requests(pairs_, one, two, cfg)
        got = {r.pair_id: (r.max_tokens, [tuple(m) for m in r.messages]) for r in out.collect()}
        chats = out.select("pair_id", "messages")
        chats.collect()
        plan = chats._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    told = pairs_.join(one, "invoice_id").join(two, "payment_id").select("pair_id", "rows_match", "first_table_row", "second_table_row")
    want = {r.pair_id: (r.max_tokens, [tuple(m) for m in r.messages]) for r in requests.build_requests(told, cfg).collect()}
    assert got == want and len(got) == 40
    assert any("ReusedExchange" in line and "first_table_row" in line and "second_table_row" in line for line in plan.splitlines())


def _orders(spark, folder):
    """Three customers with an order of three lines a year, under the names of the given tables."""
    keys = [(c * 10 + y, c, f"{1995 + y}-03-01 00:00:00", 100.0 * c + y) for c in (1, 2, 3) for y in range(4)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long, d string, o_totalprice double").selectExpr(
        "o_orderkey", "o_custkey", "cast(d as timestamp) as o_orderdate", "o_totalprice").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k[0], n, 10.0 * n) for k in keys for n in (1, 2, 3)], "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(
        f"{folder}/lineitem.parquet")
    spark.createDataFrame([(c, f"Customer#{c:09d}", 0) for c in (1, 2, 3)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "NATION_0")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def test_a_plan_of_pairs_writes_what_it_needs_of_a_match(spark, tmp_path):
    sf = _orders(spark, tmp_path)
    whole, slim = bridge.matching(spark, sf), bridge.matching(spark, sf, queries.PLANNED)
    assert slim.info.columns == list(queries.PLANNED)
    shown = lambda m: sorted(map(str, queries.plan_of(m).rows().collect()))
    assert shown(slim) == shown(whole) and len(shown(slim)) > 12


def test_the_slimmer_row_is_attached_first(spark, tmp_path):
    sf = _orders(spark, tmp_path)
    rows, other = queries.pair_rows(spark, sf, slim_first=True), queries.pair_rows(spark, sf)
    assert rows.columns[-2:] == ["target", "source"]
    assert sorted(map(str, rows.select(*other.columns).collect())) == sorted(map(str, other.collect()))


def test_pairs_are_written_kind_by_kind(spark, tmp_path, monkeypatch):
    """Each kind is a job of its own, whose shuffle files go before the next begins; together they are all pairs with their rows."""
    sf, parts, write = _orders(spark, tmp_path), [], queries.tables.write_pairs
    monkeypatch.setattr(queries.tables, "write_pairs", lambda rows, *a, **k: (parts.append({r.kind for r in rows.select("kind").distinct().collect()}), write(rows, *a, **k)))
    back = queries.QUERIES["parquet_round_trip"](spark, sf)
    assert parts == [{k} for k in pairs.KINDS]
    rows = queries.pair_rows(spark, sf).select("pair_id", "kind", "source.inv_billing_number", "target.pay_amount", F.lit("multi"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert all(f.endswith(".zstd.parquet") for f in back.inputFiles())


def test_drawn_examples_have_places_and_labels(spark):
    pool = spark.range(30).select((F.col("id") * 3).alias("pair_id"), (F.col("id") >= 18).alias("rows_match"), F.col("id").alias("_at"))
    rows = requests.drawn_examples(pool, 2, 5).collect()
    assert dict(requests.drawn_examples(pool, 2, 5).dtypes)["o"] == "int" and len(rows) == 120
    for of in {r.pair_id for r in rows}:
        own = sorted((r for r in rows if r.pair_id == of), key=lambda r: r.o)
        assert [r.o for r in own] == [0, 1, 2, 3] and of // 3 not in {r._at for r in own}
        assert all(r.label == (r._at >= 18) for r in own) and sum(r.label for r in own) == 2 and len({r._at for r in own}) == 4


def test_example_texts_are_dealt_before_they_are_grouped(spark):
    """One exchange brings the examples to their request: no aggregation sorts them where they are found."""
    pairs_ = spark.range(40).select(F.col("id").alias("pair_id"), (F.col("id") % 3 == 0).alias("rows_match"), (F.col("id") % 7).alias("invoice_id"), (F.col("id") % 5).alias("payment_id"))
    one = spark.range(7).select(F.col("id").alias("invoice_id"), F.col("id").cast("string").alias("first_table_row"))
    two = spark.range(5).select(F.col("id").alias("payment_id"), F.col("id").cast("string").alias("second_table_row"))
    plan = requests.pair_requests(pairs_, one, two, requests.RequestConfig(model="m"))._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "partial_collect_list" in line)
    assert "REPARTITION_BY_COL" in "".join(plan[at + 1:at + 3])


def test_requests_of_pairs_that_share_a_number(spark):
    """Rows with one pair_id are one request with the examples of all of them, a place after the other."""
    pairs_ = spark.range(24).select((F.col("id") % 16).alias("pair_id"), (F.col("id") % 2 == 0).alias("rows_match"), (F.col("id") % 7).alias("invoice_id"), (F.col("id") % 5).alias("payment_id"))
    one = spark.range(7).select(F.col("id").alias("invoice_id"), F.col("id").cast("string").alias("first_table_row"))
    two = spark.range(5).select(F.col("id").alias("payment_id"), F.col("id").cast("string").alias("second_table_row"))
    sizes = Counter((r.pair_id, len(r.messages)) for r in requests.pair_requests(pairs_, one, two, requests.RequestConfig(model="m", draw_seed=1)).collect())
    assert sum(sizes.values()) == 24 and {p for p, _ in sizes} == set(range(16)) and all(n == (2 if p < 8 else 1) for (p, _), n in sizes.items())
    assert min(m for p, m in sizes if p < 8) >= 2 + 2 * 4
