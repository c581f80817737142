"""Living archives, picks, boards, logs, generated instances, batches as values, axes and ranks against plain loops and round trips."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import generator
from orrery.operators import bandit, live_archive, partition, projection
from orrery.sources import arrow_batches, logs
from orrery.streaming import live

NAMES = [x.split(" ")[0] for x in live_archive.STEP.split(", ")]


def random_steps(seed, n=250, archives=2):
    rng, out = random.Random(seed), []
    for a in range(archives):
        for k in range(n):
            kind = "reeval" if rng.random() < 0.3 else "insert"
            p = rng.choice([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
            out.append((f"a{a}", k, kind, f"p{rng.randint(0, 25)}", p, rng.choice([1.0, 2.0, 3.5]), rng.randint(0, 2), rng.randint(0, 1), rng.randint(0, 4), rng.random() < 0.95, rng.choice([None, f"b{rng.randint(0, 40)}"]), rng.choice([None, f"t{rng.randint(0, 60)}"])))
    return out


def by_hand(rows, size, promote):
    """The same story told with one list of places: [cell, seat (0: champion), program], reservoirs in order."""
    places, out = [], []

    def champion(cell):
        return next((p for c, s, p in places if c == cell and s == 0), None)

    def pool(cell):
        return [p for c, s, p in places if c == cell and s == 1]

    def reserve(prog, cell):
        here = pool(cell)
        if size <= 0 or (champion(cell) or {}).get("id") == prog["id"] or prog["id"] in [p["id"] for p in here]:
            return False
        here = sorted([*here, prog], key=lambda p: (p["rq"], p["gen"]), reverse=True)[:size]
        places[:] = [x for x in places if not (x[0] == cell and x[1] == 1)] + [[cell, 1, p] for p in here]
        return any(p is prog for p in here)

    def insert(prog, cell):
        if not prog["valid"]:
            return "seed_variation_rejected", None, None
        for sig, name in (("b", "duplicate_rejected"), ("t", "template_duplicate_rejected")):
            for c, s, p in sorted(places, key=lambda x: (x[0], x[1])):
                if prog[sig] is not None and p[sig] == prog[sig] and p["id"] != prog["id"]:
                    return name, p["id"], None
        top = champion(cell)
        if top and not prog["rq"] > top["rq"]:
            if any(s == 0 and c != cell and p["id"] == prog["id"] for c, s, p in places):
                return "rejected", None, None
            return ("reservoir" if reserve(prog, cell) else "rejected"), None, None
        places[:] = [x for x in places if not (x[0] == cell and x[1] == 0)] + [[cell, 0, prog]]
        if top and top["id"] != prog["id"]:
            reserve(top, cell)
        places[:] = [x for x in places if x[0] == cell or x[2]["id"] != prog["id"]]
        return ("replaced" if top else "inserted"), None, top and top["id"]

    def move_up(cell):
        if promote and champion(cell) is None and pool(cell):
            best = pool(cell)[0]
            next(x for x in places if x[0] == cell and x[2] is best)[1] = 0
            return best["id"]
        return None

    for r in map(lambda t: dict(zip(NAMES, t, strict=True)), rows):
        cell, rq, up = (r["h_bin"], r["div_bin"]), r["p_hat"] * (1 - r["p_hat"]) * r["u"], None
        if r["kind"] == "insert":
            status, twin, old = insert({"id": r["program_id"], "rq": rq, "gen": r["generation"], "valid": r["valid"], "b": r["behaviour"], "t": r["template"]}, cell)
        else:
            seat = next((x for x in places if x[1] == 0 and x[2]["id"] == r["program_id"]), None)
            twin = old = None
            if seat is None:
                status, rq = "no_champion", None
            elif r["p_hat"] == 0:
                places.remove(seat)
                status, up = "evicted", move_up(seat[0])
            elif seat[0] == cell:
                seat[2] = seat[2] | {"rq": rq}
                places[:] = [x for x in places if x[0] == cell or x[2]["id"] != r["program_id"]]
                status = "rescored"
            else:
                places.remove(seat)
                status, twin, old = insert(seat[2] | {"rq": rq}, cell)
                status, up = f"moved_{status}", move_up(seat[0])
        out.append((r["archive_id"], r["seq"], r["kind"], r["program_id"], status, *cell, rq, twin, old, up))
    return out


def wanted(rows, size, promote):
    return sorted((x for a in sorted({r[0] for r in rows}) for x in by_hand([r for r in rows if r[0] == a], size, promote)), key=repr)


@pytest.mark.parametrize(("size", "promote"), [(4, False), (2, True), (0, True), (1, False)])
def test_live_replay(spark, size, promote):
    rows = random_steps(size + promote)
    d = spark.createDataFrame(rows, live_archive.STEP).orderBy(F.rand(3)).withColumn("extra", F.lit(1))
    want = wanted(rows, size, promote)
    assert sorted((tuple(r) for r in live_archive.live_replay(d, size, promote).collect()), key=repr) == want
    assert {"rescored", "evicted", "reservoir", "replaced", "duplicate_rejected"} - ({"reservoir"} if size == 0 else set()) <= {r[4] for r in want}
    assert any(r[4].startswith("moved_") for r in want) and (not promote or size == 0 or any(r[10] for r in want))
    assert live_archive.live_replay(d.limit(0)).count() == 0


def write_lines(folder, rows, rng, files):
    for k in range(files):
        with open(folder / f"{rng.random()}-{k}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows[k::files])


def until_done(df, sink, path, mode):
    q = sink(df.writeStream.outputMode(mode).option("checkpointLocation", str(path))).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_live_stream_after_restarts(spark, tmp_path):
    rng, rows = random.Random(6), random_steps(9, 120)
    named = [dict(zip(NAMES, r, strict=True)) for r in rows]
    rng.shuffle(named)
    (tmp_path / "in").mkdir()
    for part in (named[:90], named[90:200], named[180:]):  # some come twice; each part is a run of its own
        write_lines(tmp_path / "in", part, rng, 3)
        s = spark.readStream.schema(live_archive.STEP).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
        until_done(live.live_stream(s, 2, True), lambda w: w.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "ck", "append")
    got = sorted((tuple(r) for r in spark.read.schema(live_archive.FATE).parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == wanted(rows, 2, True)


def test_board_of_a_running_run(spark, tmp_path):
    """In flight until the snapshot comes; the stream's board equals the table's after any split and after restarts."""
    rng, (names, kinds) = random.Random(2), zip(*[x.split(" ") for x in live.RECORD.split(", ")], strict=True)
    rows = [("event", s, rng.choice(["candidate_failed", "candidate_scored"]), rng.choice(["inserted", None]), None, None, f"p{i}", None) for s in range(5) for i in range(rng.randint(1, 9))]
    cells = [("snapshot", s, None, None, h, h % 2, f"p{h}", rng.choice([0.25, 0.5, h / 7])) for s in range(4) for h in range(4)]
    (tmp_path / "in").mkdir()
    done = []
    for part in (rows[:10], rows[10:] + cells[:6], cells[6:]):
        done += part
        write_lines(tmp_path / "in", [dict(zip(names, r, strict=True)) for r in part], rng, 3)
        s = spark.readStream.schema(live.RECORD).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        until_done(live.step_board(s), lambda w: w.foreachBatch(live.board_into(str(tmp_path / "board"))), tmp_path / "ck", "update")
        got = live.board(spark, str(tmp_path / "board"))
        want = live.step_board(spark.createDataFrame(done, live.RECORD))
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r.step: r.in_flight for r in got.collect()} == {0: False, 1: False, 2: False, 3: False, 4: True}


def picks_by_hand(entries, picks, seed, epsilon, c, pairs):
    """Entries (cell, id, rq) in order; counts by cell in a dict, ranks by counting."""
    visits, total, out = {}, 0, []

    def once(tag, pool):
        nonlocal total
        if bandit.unit(seed, tag, "u") < epsilon:
            got, how = pool[int(bandit.unit(seed, tag, "v") * len(pool))], "uniform"
        else:
            best = None
            for i, (cell, name, rq) in enumerate(pool):
                below = sum(1 for j, e in enumerate(pool) if (e[2], j) < (rq, i))
                score = (below / (len(pool) - 1) if len(pool) > 1 else 1.0) + (c * math.sqrt(math.log(total + 1) / visits[cell]) if cell in visits else math.inf)
                if best is None or score > best[0]:
                    best = (score, (cell, name, rq))
            got, how = best[1], "ucb"
        visits[got[0]] = visits.get(got[0], 0) + 1
        total += 1
        return got[1], how

    for k in range(picks):
        if not pairs:
            out.append((k, *once(str(k), entries), None, None))
        elif len({e[1] for e in entries}) > 1:
            a = once(f"{k}a", entries)
            out.append((k, *a, *once(f"{k}b", [e for e in entries if e[1] != a[0]])))
    return out


@pytest.mark.parametrize("pairs", [False, True])
def test_picks(spark, pairs):
    rng, rows, want = random.Random(5), [], []
    for a in range(6):
        own = [(f"a{a}", h, 0, f"p{h}", rng.choice([0.1, 0.2, 0.3]), "champion") for h in range(rng.choice([1, 2, 7]))]
        own += [(f"a{a}", h, 0, f"r{h}", 0.05, "reservoir") for h in range(rng.choice([0, 2]))] + ([("a0", 9, 1, "p0", 0.9, "champion")] if a == 0 else [])
        rows += own
        entries = [((r[1], r[2]), r[3], r[4]) for r in sorted(own, key=lambda r: (r[1], r[2], r[5] != "champion", -r[4], r[3]))]
        want += [(f"a{a}", *p) for p in picks_by_hand(entries, 12, f"s|a{a}", 0.3, 0.7, pairs)]
    d = spark.createDataFrame(rows, "archive_id string, h_bin int, div_bin int, program_id string, rq double, pool string").orderBy(F.rand(1))
    got = bandit.pick_parents(d, 12, "s", 0.3, 0.7, pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and {w[3] for w in want} == {"uniform", "ucb"}


def test_axis(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [1, 5, 1, 2, 1, 1] @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 1000
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [])]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    axis = projection.fit_axis(d, "v")
    direction = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    direction *= np.sign(direction[np.abs(direction).argmax()])
    assert np.allclose(axis.direction, direction, atol=1e-8) and np.allclose(axis.mean, x.mean(axis=0))
    y = (x - x.mean(axis=0)) @ direction
    low, high = y.min() - 0.1 * np.ptp(y), y.max() + 0.1 * np.ptp(y)
    got = {r.id: r.b for r in d.select("id", axis.bin(F.col("v"), 6, F.col("id")).alias("b")).collect()}
    assert [got[i] for i in range(300)] == [min(int((v - low) / ((high - low) / 6)), 5) for v in y] and 0 <= got[900] < 6
    assert projection.fit_axis(d.where("id >= 900"), "v") is None
    with pytest.raises(Exception, match="lengths"):
        projection.fit_axis(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "v")


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(b, i, rng.choice([1, 5, 100, rng.randint(1, 1000)])) for b in range(8) for i in range(4 * rng.randint(1, 12))]
    out = partition.balance_ranks(spark.createDataFrame(rows, "batch_id long, item_id long, seqlen long"), 4)
    got = out.toPandas()
    for b, g in got.groupby("batch_id"):
        own = [r for r in rows if r[0] == b]
        assert sorted(g.new_pos) == sorted(g.pos) == list(range(len(own))) and list(g.sort_values("pos").item_id) == [r[1] for r in own]
        assert (g.part == g.new_pos // (len(own) // 4)).all()
        loads = g.groupby("part").seqlen.sum()
        assert loads.max() - loads.min() <= g.seqlen.max()
    back = partition.restored(out, out.select("batch_id", "new_pos", (F.col("seqlen") * 2).alias("x")))
    assert {(r.batch_id, r.item_id): r.x for r in back.collect()} == {(b, i): 2 * n for b, i, n in rows}
    with pytest.raises(Exception, match="divides"):
        partition.balance_ranks(spark.createDataFrame(rows[:3], "batch_id long, item_id long, seqlen long"), 4).collect()


def test_generated_instances(spark):
    endless, big = "def generate(s):\n    while s: pass\n    return 'p', s", "def generate(s):\n    return 'x' * 200_000, 1"
    quits, eats = "import os\ndef generate(s):\n    os._exit(3)", "def generate(s):\n    return 'p', len('x' * (1 << 40))"
    rows = [("a", "def generate(s):\n    return f'{s}?', s"), ("b", endless), ("c", big), ("d", quits), ("e", eats), ("f", None), ("g", "import sys\ndef generate(s):\n    print('[0, 1, 2]'); sys.exit()")]
    d = spark.createDataFrame(rows, "id string, source_code string").coalesce(1)
    got = sorted(((r.id, r.seed, r.problem, r.answer, r.error) for r in generator.instances(d, 2, seconds=1.0).collect()), key=repr)
    bad = [(i, s, None, None, e) for i, e in (("c", "too long"), ("d", "process ended"), ("e", "MemoryError"), ("g", "SystemExit")) for s in (0, 1)]
    assert got == sorted([("a", 0, "0?", "0", None), ("a", 1, "1?", "1", None), ("b", 0, "p", "0", None), ("b", 1, None, None, "timeout"), *bad], key=repr)
    generator.register(spark)
    d.createOrReplaceTempView("programs")
    assert spark.sql("SELECT id, seed, answer FROM programs, LATERAL generate_instances(source_code, 3) WHERE id = 'a' ORDER BY seed").collect()[2].answer == "2"


def test_batches_as_values(spark, tmp_path):
    rows = [(1, [1, None], {"a": None}, (1, None)), (1, None, None, None), (2, [], {}, (2, "x")), (None, [3], {"b": 2.0}, (3, ""))]
    d = spark.createDataFrame(rows, "k long, xs array<int>, m map<string,double>, s struct<a:int,b:string>")
    packed = arrow_batches.to_batches(d, "k")
    assert {(r.k, r.n) for r in packed.collect()} == {(1, 2), (2, 1), (None, 1)}
    back = arrow_batches.from_batches(packed)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, d.collect())) and [f.dataType for f in back.schema] == [f.dataType for f in d.schema]
    value = arrow_batches.empty_batch(d.schema)
    more = packed.select("data").union(spark.createDataFrame([(value,), (None,)], "data binary"))
    assert arrow_batches.from_batches(more, d.schema).count() == 4
    arrow_batches.save_batch(spark, bytes(packed.where("k = 1").first().data), f"{tmp_path}/b.arrow")
    assert arrow_batches.load_batch(spark, f"{tmp_path}/b.arrow").count() == 2
    assert arrow_batches.to_batches(d.limit(0), "k").count() == 0
    with pytest.raises(ValueError, match="schema"):
        arrow_batches.from_batches(packed.limit(0))


def test_event_log_goes_on(spark, tmp_path):
    """Numbers go on over commits, repeats and a writer that was stopped halfway."""
    log = logs.EventLog(spark, f"{tmp_path}/log")
    assert log.read() is None
    part = lambda a, b: spark.range(a, b).select("id", F.lit("x").alias("event")).repartition(3)
    log.append(part(0, 1000), 0, ["id"])
    log.append(part(1000, 1000), 1, ["id"])
    part(5000, 6000).write.parquet(f"{tmp_path}/log/commit=2")  # stopped before its marker
    assert log.read().count() == 1000
    again = logs.EventLog(spark, f"{tmp_path}/log")
    for _ in range(2):
        again.append(part(1000, 1500), 2, ["id"], time=7.0)
    with pytest.raises(ValueError, match="before"):
        spark.range(0).select("id", F.lit("x").alias("event"))
        logs.EventLog(spark, f"{tmp_path}/log").append(part(0, 1), -1, ["id"])
    got = again.read()
    assert sorted((r.event_seq, r.id) for r in got.collect()) == [(i, i) for i in range(1500)]
    assert got.where("id >= 1000 and time <> 7.0").count() == 0 and set(got.columns) == {"id", "event", "time", "event_seq"}


def test_event_log_of_a_stream(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    log, ids = logs.EventLog(spark, f"{tmp_path}/log"), list(range(60))
    for k in range(3):
        write_lines(src, [{"id": i} for i in ids[20 * k : 20 * k + 20]], random.Random(k), 2)
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(src))
        until_done(s, lambda w: w.foreachBatch(log.into(["id"])), tmp_path / "ck", "append")
    rows = log.read().collect()
    assert sorted(r.event_seq for r in rows) == ids and sorted(r.id for r in rows) == ids


def test_latest_snapshot(spark, tmp_path):
    path = f"{tmp_path}/snap"
    assert logs.snapshot(spark, path) is None
    one = lambda n: spark.range(n)
    logs.save_snapshot(one(3), path, 1)
    held = logs.snapshot(spark, path)
    logs.save_snapshot(one(4), path, 2)
    assert (held.count(), logs.snapshot(spark, path).count()) == (3, 4)
    with pytest.raises(Exception, match="broken"):  # a writer that ends halfway leaves the old latest
        logs.save_snapshot(one(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id")), path, 3)
    assert logs.snapshot(spark, path).count() == 4 and logs.snapshot(spark, path, 3) is None
    logs.save_snapshot(one(5), path, 1)  # an earlier step again: replaced, but not the latest
    assert (logs.snapshot(spark, path).count(), logs.snapshot(spark, path, 1).count()) == (4, 5)


@pytest.mark.parametrize("method", ["largest_differencing", "least_loaded", "micro", "ranks"])
def test_many_small_batches_share_a_call(spark, method):
    """One Python call a batch took over 150 s for 150,000 batches; batches also lie across the borders of Arrow batches."""
    rng = random.Random(7)
    rows = [(b, i, rng.randint(1, 900)) for b in [None, *range(60)] for i in rng.sample(range(1000), 4 * rng.randint(1, 9))]
    items = spark.createDataFrame(rows, "batch_id long, item_id long, seqlen long").repartition(3)
    parts = {
        "largest_differencing": (lambda d: partition.balanced(d, 2), lambda s: partition.largest_differencing(s, 2)),
        "least_loaded": (lambda d: partition.balanced(d, 2, method="least_loaded"), lambda s: partition.least_loaded(s, 2)),
        "micro": (lambda d: partition.micro_batches(d, 1000), lambda s: partition.largest_differencing(s, min(max(-(-sum(s) // 1000), 1), len(s)))),
        "ranks": (lambda d: partition.balance_ranks(d, 4), lambda s: partition.largest_differencing(s, 4, equal_size=True)),
    }
    dealt, pick = parts[method]
    want = []
    for b in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == b)
        want += [(b, *own[i], p) for p, held in enumerate(pick([n for _, n in own])) for i in held]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = dealt(items)
        assert sorted((tuple(r)[:4] for r in out.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_children_without_a_parent_are_spread(spark):
    """All rows without a second parent met in the task of the null key."""
    from orrery.plans.lineage import with_parents

    kids = spark.range(600).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.concat_ws("x", F.hex(F.floor(F.col("id") / 2)), F.hex(F.floor(F.col("id") / 3)))).otherwise(F.hex(F.floor(F.col("id") / 2))).alias("parent_id"))
    programs = spark.range(200).select(F.col("id").alias("seq"), F.lit("t").alias("kind"), F.lit("g").alias("grp"), F.lit(0).alias("generation"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_parents(kids, programs).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {(r.seq, r.a_id, r.b_id, r.a_kind, r.b_kind) for r in got} == {
        (i, i // 2, b, "t" if i // 2 < 200 else None, "t" if b is not None and b < 200 else None) for i in range(600) for b in [i // 3 if i % 3 == 0 else None]
    }
    assert len(got) == 600 and len({r.part for r in got if r.b_id is None}) == 4


def test_archive_replay_holds_no_archive(spark):
    """A whole archive went to Python as one frame: 160 MB of a worker on 600,000 events, growing with them."""
    from orrery.operators import archive

    rng = random.Random(3)
    rows = [(a, k, f"p{rng.randint(0, 20)}", rng.choice([None, rng.random()]), rng.randint(0, 2), rng.randint(0, 1), rng.choice([True, True, None]), rng.choice([None, f"b{rng.randint(0, 9)}"]), None) for a in (None, "a", "b") for k in range(40)]
    d = spark.createDataFrame(rows, "archive_id string, seq long, program_id string, rq double, h_bin int, div_bin int, valid boolean, behaviour string, template string").repartition(3)
    names, want = d.columns, []
    for a in (None, "a", "b"):
        fold = archive.Fold()
        for r in (dict(zip(names, x)) for x in rows if x[0] == a):
            got = fold.insert(r | {"rq": math.nan if r["rq"] is None else r["rq"]})
            want.append((a, r["seq"], r["program_id"], got["status"], r["h_bin"], r["div_bin"], got["duplicate_of"], got["replaced"]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = archive.replay(d)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("promote", [False, True])
def test_live_replay_holds_no_archive(spark, promote):
    rows = random_steps(17, 60, 3)
    d = spark.createDataFrame(rows, live_archive.STEP).repartition(3)
    want = []
    for a in sorted({r[0] for r in rows}):
        want += live_archive.fates(live_archive.LiveArchive(2, promote), a, [dict(zip(NAMES, r)) for r in rows if r[0] == a])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = live_archive.live_replay(d, 2, promote)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_rank_balance_reads_its_rows_once(spark):
    """The rows and their copies were two scans, two sorts and a union, in as many tasks for a large table as for a small one."""
    from orrery.plans import living

    d = "/root/testdata/sf0.001"
    out = living.rank_balance(spark, d)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    want, own = [], {}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").collect():
        own.setdefault(r[0], []).append((int(r[3]), r[1] * 10 + r[2]))
    for b, rows in own.items():
        if len(rows) >= 4:
            items = sorted([(i, n) for n, i in rows] + [(-i, n) for n, i in sorted(rows)[: -len(rows) % 4]])
            want += [(b, *items[i], p) for p, held in enumerate(partition.largest_differencing([n for _, n in items], 4, equal_size=True)) for i in held]
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(want)
