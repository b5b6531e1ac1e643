"""Operators that must stay exact when keys are hot: brute force on skewed data."""

import random

import numpy as np
from pyspark.sql import functions as F

from vigilark.functions.timeblocks import latest_before, running_sum, sliding_count
from vigilark.operators import activity, clusters, similarity, vector_index
from vigilark.plans import derive


def skewed(n, seed=5, span=400_000):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", rng.randint(0, span), i)
            for i in range(n)]


def test_sliding_count_across_blocks(spark):
    data = skewed(3000)
    frame = spark.createDataFrame(data, "key string, second bigint, n_id int").drop("n_id")
    for width in (90, 50_000):
        got = {(r.key, r.second): r.n_in_window
               for r in sliding_count(frame, ["key"], "second", width).collect()}
        times = {}
        for key, second, _ in data:
            times.setdefault(key, []).append(second)
        assert got == {(k, s): sum(s - width <= t <= s for t in ts) for k, ts in times.items() for s in ts}


def test_latest_before_across_blocks(spark):
    asks, answers = skewed(800, 1), skewed(300, 2)
    schema = "key string, second bigint, n_id int"
    got = {(r.key, r.second): r.matched_second for r in latest_before(
        spark.createDataFrame(asks, schema), spark.createDataFrame(answers, schema),
        ["key"], "second", 20_000).collect()}
    want = {}
    for key, second, _ in asks:
        near = [t for k, t, _ in answers if k == key and second - 20_000 <= t <= second]
        if near:
            want[key, second] = max(near)
    assert got == want and want


def test_running_sum_of_a_hot_key(spark):
    data = skewed(2000)
    frame = spark.createDataFrame(data, "key string, second bigint, n_id int").repartition(7)
    got = {r.n_id: r.total for r in
           running_sum(frame, ["key"], ["second", "n_id"], F.lit(1), "total").collect()}
    want, seen = {}, {}
    for key, second, n in sorted(data, key=lambda d: (d[1], d[2])):
        seen[key] = seen.get(key, 0) + 1
        want[n] = seen[key]
    assert got == want


def test_ip_seen_matches_the_counts(spark):
    rng = random.Random(9)
    data = [(f"u{i:04d}", rng.randint(0, 60_000), rng.choice(["a", "a", "b", "c", None]),
             rng.choice(["a", "b", "", None])) for i in range(900)]
    frame = spark.createDataFrame(data, "log_uuid string, s bigint, source_ip string, dest_ip string"
                                  ).withColumn("event_timestamp", F.timestamp_seconds("s"))
    counts, prior, flags = {}, {}, {}
    for uuid, s, src, dst in sorted(data, key=lambda d: (d[1], d[0])):
        ips = [ip for ip in (src, dst) if ip]
        for ip in set(ips):
            prior[uuid, ip] = sum(counts.get((ip, s // 3600 - h), 0) for h in range(4))
        if ips:
            flags[uuid] = any(prior[uuid, ip] > 0 for ip in ips)
        for ip in ips:
            counts[ip, s // 3600] = counts.get((ip, s // 3600), 0) + 1
    assert {(r.log_uuid, r.ip): r.prior_count for r in activity.ip_activity(frame).collect()} == prior
    assert {r.log_uuid: r.ip_seen for r in activity.ip_seen(frame).collect()} == flags


def vector_frame(spark, n=260, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    vectors = centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dim))
    vectors[::9] = vectors[0]  # copies
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # Two thirds of the rows share one hour.
    times = np.where(np.arange(n) % 3 > 0, 5000 + np.arange(n), 7000 * (np.arange(n) % 11))
    rows = [(f"v{i:04d}", float(times[i]), "DNS_QUERY" if i % 2 else "FILE_WRITE",
             [float(np.float32(x)) for x in vectors[i]]) for i in range(n)]
    return rows, spark.createDataFrame(
        rows, "id string, event_epoch double, event_type string, embedding array<float>")


def brute_force(rows, k=20, threshold=0.72):
    width = {"DNS_QUERY": 21600, "FILE_WRITE": 3600}
    out = set()
    for tid, t, kind, vec in rows:
        scored = sorted((-round(float(np.dot(vec, v) / np.linalg.norm(vec) / np.linalg.norm(v)), 9), i)
                        for i, s, _, v in rows if abs(s - t) <= width[kind])[:k]
        out |= {(tid, i, round(-s, 4)) for s, i in scored if -s >= threshold and i != tid}
    return out


def test_search_is_exact_for_any_chunking(spark):
    rows, frame = vector_frame(spark)
    want = brute_force(rows)
    for chunk_rows in (7, 2000):
        hits = similarity.correlate(frame, frame, chunk_rows=chunk_rows).collect()
        assert {(r.trigger_id, r.id) for r in hits} == {w[:2] for w in want}
    summary = similarity.correlation_summary(frame, similarity.correlate(frame, frame), frame)
    assert summary.filter("cold_start").count() == len({r[0] for r in rows} - {w[0] for w in want})


def test_squared_distance_is_twice_cosine_minus_one(spark):
    _, frame = vector_frame(spark, 120)
    cosine = {(r.trigger_id, r.id): r.similarity for r in
              similarity.correlate(frame, frame, threshold=0.86).collect()}
    squared = {(r.trigger_id, r.id): r.similarity for r in
               similarity.correlate(frame, frame, threshold=0.72, metric="l2sq").collect()}
    assert cosine.keys() == squared.keys() and cosine
    assert all(abs(2 * cosine[k] - 1 - squared[k]) < 3e-4 for k in cosine)


def pairs_of(frame):
    return {(r.trigger_id, r.id, r.similarity) for r in frame.collect()}


def test_index_finds_what_comparing_all_finds(spark, tmp_path):
    _, frame = vector_frame(spark)
    index = vector_index.build(frame, str(tmp_path / "index"), cells=6, sample=40)
    for chunk_rows in (7, 2000):
        assert pairs_of(vector_index.correlate_indexed(frame, frame, index, chunk_rows=chunk_rows)) == pairs_of(similarity.correlate(frame, frame))


def test_index_grows_by_cells(spark, tmp_path):
    """Rows that come later touch the folders of their cells only, and are found, however far from the first ones."""
    _, frame = vector_frame(spark)
    first, later = frame.filter("id < 'v0130'"), frame.filter("id >= 'v0130'")
    path = str(tmp_path / "index")
    vector_index.build(first, path, cells=4, sample=50)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    vector_index.insert(later, path)
    assert all(f.stat().st_mtime_ns == at for f, at in files.items())
    index = vector_index.read(spark, path)
    assert pairs_of(vector_index.correlate_indexed(frame, frame, index)) == pairs_of(similarity.correlate(frame, frame))


def test_registered_index_compares_a_tenth(spark, tmp_path):
    """The query's own vectors and settings: every neighbour is found, and few pairs are compared in full."""
    rows = similarity.with_window(derive.vectors(spark, "/root/testdata/sf0.1"))
    index = vector_index.build(rows, str(tmp_path / "index"), cells=8)
    compared = vector_index.candidates(rows, index, 20, 0.3).count()
    near = similarity.temporal_candidates(rows, rows).agg(F.sum("n_candidates")).first()[0]
    assert compared < near / 10
    assert pairs_of(vector_index.correlate_indexed(rows, rows, index, threshold=0.3)) == pairs_of(similarity.correlate(rows, rows, threshold=0.3))


def test_far_cells_are_not_probed(spark, tmp_path):
    """Three tight groups: a trigger meets the rows of its own group only."""
    rng = np.random.default_rng(2)
    groups = np.eye(8)[rng.integers(0, 3, 600)] + rng.normal(size=(600, 8)) * 0.02
    frame = spark.createDataFrame([(f"v{i:03d}", float(i), "DNS_QUERY", v.tolist()) for i, v in enumerate(groups)],
                                  "id string, event_epoch double, event_type string, embedding array<double>")
    timed = similarity.with_window(frame)
    index = vector_index.build(frame, str(tmp_path / "index"), cells=12)
    cells = vector_index.probes(timed, index, 0.72).groupBy("trigger_id").count().agg(F.max("count")).first()[0]
    assert cells <= 10 and index.rows.select("cell").distinct().count() == 12
    compared = vector_index.candidates(timed, index, 20, 0.72).count()
    assert compared < 600 * 600 / 5
    empty = frame.limit(0)
    assert vector_index.correlate_indexed(empty, frame, index).collect() == []


def copies_frame(spark, n=420):
    """Two hours with many copies of few vectors, serious and other rows mixed."""
    rng = np.random.default_rng(7)
    kinds = rng.standard_normal((9, 5))
    rows = [(f"v{i:04d}", float(rng.integers(0, 9000) if i % 4 else 40_000 + rng.integers(0, 9000)), "EXFILTRATION_HINT" if rng.random() < 0.12 else
             ("FILE_WRITE" if rng.random() < 0.1 else "DNS_QUERY"), [float(x) for x in kinds[min(int(rng.exponential(2)), 8)]]) for i in range(n)]
    rows += [("z1", 100.0, "EXFILTRATION_HINT", [0.0] * 5), ("z2", 100.0, "EXFILTRATION_HINT", [0.0] * 5)]
    return rows, spark.createDataFrame(rows, "id string, event_epoch double, event_type string, embedding array<double>")


def test_classes_of_copies_say_every_link(spark):
    rows, frame = copies_frame(spark)
    width = {"EXFILTRATION_HINT": 1800, "FILE_WRITE": 3600}
    classes, members = similarity.copy_classes(frame, F.col("event_type").isin(*width))
    for chunk_rows in (5, 2000):
        pairs = similarity.similar_classes(classes, 0.6, chunk_rows=chunk_rows)
        got = {(r.trigger_id, r.id) for r in similarity.expanded(pairs, classes, members).collect()}
        want = {(i, j) for i, t, k, v in rows if k in width for j, s, _, w in rows if i != j and abs(s - t) <= width[k]
                and np.linalg.norm(v) * np.linalg.norm(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.6}
        assert got == want
    assert pairs.count() < len(want) / 2
    parent = {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for pair in want for x in pair}
    got = {(r.id, r.cluster): r.cluster_size for r in clusters.attack_clusters(pairs, classes, members).collect()}
    assert set(got) == {(i, root(i)) for i in linked} and len({root(i) for i in linked}) > 1
    assert all(size == sum(root(i) == c for i in linked) for (_, c), size in got.items())


def test_copies_make_few_rows(spark):
    """A thousand copies of one serious row in half an hour: one pair."""
    frame = spark.range(1000).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), (F.col("id") * 1.5 + 1800).alias("event_epoch"),
                                     F.lit("EXFILTRATION_HINT").alias("event_type"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    classes, members = similarity.copy_classes(frame, F.col("event_type") == "EXFILTRATION_HINT")
    pairs = similarity.similar_classes(classes)
    assert [tuple(r) for r in pairs.collect()] == [("r0000", "r0000", 1.0, True)]
    assert {(r.cluster, r.cluster_size) for r in clusters.attack_clusters(pairs, classes, members).collect()} == {("r0000", 1000)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)]
    got = {r.id: r.cluster for r in clusters.connected_components(
        spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"c{i:03d}"] for i in range(41)} == {"c000"}
    assert {got[x] for x in ["hub", *[f"s{i}" for i in range(60)]]} == {"hub"}


def test_similar_pairs_say_every_link(spark):
    """Pairs and members together, and nothing else, give the links of all rows."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    rows = [(f"v{i:03d}", [float(x) for x in base[i % 12]], float(i * 97),
             ["PRIVILEGE_ESCALATION", "DNS_QUERY", "FILE_WRITE"][i // 12 % 3]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>, event_epoch double, event_type string")
    serious = F.col("event_type") == "PRIVILEGE_ESCALATION"
    classes, members = similarity.copy_classes(vectors, serious)
    found = similarity.pairs_and_members(similarity.similar_classes(classes, 0.25), members).collect()
    held = {}
    for r in (r for r in found if r.kind == "member"):
        held.setdefault(r.trigger_id, []).append(r)
    assert sorted(r.id for m in held.values() for r in m) == [r[0] for r in rows]
    got = {(a.id, b.id) for r in found if r.kind == "pair" for a in held[r.trigger_id] for b in held[r.id]
           if a.id != b.id and (r.whole or abs(a.event_epoch - b.event_epoch) <= a.window_s)}
    width = {r[0]: w for r, w in zip(rows, [x.window_s for x in similarity.with_window(vectors).orderBy("id").collect()])}
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = {(a[0], b[0]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and a[3] == "PRIVILEGE_ESCALATION"
            and abs(a[2] - b[2]) <= width[a[0]] and round(float(unit[i % 12] @ unit[j % 12]), 9) >= 0.25}
    assert want and got == want
