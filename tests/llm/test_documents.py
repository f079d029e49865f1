"""Operators on documents against brute force, on odd rows and none."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitemill.llm import flac, gam, media, rules, sentences, sharding, simhash, suffixarray, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# sharding


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_visits_neighbours(spark, n, bits):
    side = 1 << bits
    points = spark.range(side**n).select(*[(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"x{k}") for k in range(n)])
    rows = points.withColumn("at", sharding.hilbert_index([F.col(f"x{k}") for k in range(n)], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(side**n))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[k] - b[k]) for k in range(n)) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_odd_documents(odd, none, law):
    got = sharding.hilbert_shards(odd, 7, ["source", "lang", "size"], law).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r)
    assert all(0 <= s < 7 for s in held)
    for rows in held.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    order = [r["curve"] for s in sorted(held) for r in sorted(held[s], key=lambda r: r["slot"])]
    assert order == sorted(order)
    if law == "rows":
        sizes = [len(held[s]) for s in range(7)]
        assert max(sizes) - min(sizes) <= 1
    else:
        share, most = sum(r["size"] for r in got) / 7, max(r["size"] for r in got)
        assert all(abs(sum(r["size"] for r in rows) - share) <= most for rows in held.values())
    assert sharding.hilbert_shards(none, 7, ["source", "lang"], law).count() == 0
    with pytest.raises(ValueError):
        sharding.hilbert_shards(odd, 7, ["lang"], "other")


def test_shards_against_hand_made_ones(odd, spark):
    """Codes, bins and ranks counted out; the curve's own places are tested above."""
    rows = odd.collect()
    n, bits, sources, langs = len(rows), 5, ["a", "b", "https://x"], ["de", "en"]

    def two_bytes(value, known):
        shared = 0
        while len({k.encode()[: shared + 1] for k in (known[0], known[-1])}) == 1 and shared < len(known[0]):
            shared += 1
        tail = (value.encode()[shared : shared + 2]).hex().ljust(4, "0")
        return min(65535, int(tail, 16) + 1)

    codes = {"source": [0 if r["source"] is None else two_bytes(r["source"], sources) for r in rows], "lang": [0 if r["lang"] is None else two_bytes(r["lang"], langs) for r in rows], "doc_id": [0 if r["doc_id"] is None else min(65535, math.floor(math.log2(r["doc_id"] + 1) * 1000) + 1) for r in rows]}
    bins = {d: [(sum(x < c for x in column) << bits) // n for c in column] for d, column in codes.items()}
    points = sorted(set(zip(*(bins[d] for d in codes), strict=True)))
    at = spark.createDataFrame(points, "x int, y int, z int").withColumn("at", sharding.hilbert_index([F.col(c) for c in "xyz"], bits)).collect()
    curve = {(r["x"], r["y"], r["z"]): r["at"] for r in at}
    keyed = sorted((curve[tuple(bins[d][i] for d in codes)], r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode())) for i, r in enumerate(rows))
    first = [-(-s * n // 7) for s in range(7)]
    want = [(*k, i * 7 // n, i - first[i * 7 // n]) for i, k in enumerate(keyed)]
    got = sharding.hilbert_shards(odd, 7, ["source", "lang", "doc_id"]).collect()
    assert sorted((r["curve"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["shard"], r["slot"]) for r in got) == sorted(want)


def test_rows_alike_in_everything_are_spread(spark, monkeypatch):
    """A third of all rows without id and text: many tasks order them."""
    held = {}
    write = sharding.Scratch.write

    def kept(self, df, label):
        held[label] = write(self, df, label)
        return held[label]

    monkeypatch.setattr(sharding.Scratch, "write", kept)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"), F.lit("s").alias("source")).repartition(4)
    got = sharding.hilbert_shards(rows, 40, ["source", "doc_id"]).collect()
    assert Counter(r["shard"] for r in got) == dict.fromkeys(range(40), 75)
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(75)) for s in (0, 20, 39))
    parts = held["curve"].where("doc_id IS NULL").select(F.shiftright("place", 33).alias("p")).groupBy("p").count().collect()
    assert len(parts) >= 2 and sum(r["count"] for r in parts) == 1000


def test_written_shards_hold_every_row_once(odd, tmp_path, spark):
    sharding.write_shards(odd, sharding.hilbert_shards(odd, 5, ["source", "lang"]), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r["row"]) for r in back.collect()) == Counter(tuple(r) for r in odd.collect())
    assert back.select("shard").distinct().count() == 5


def test_zone_map_prunes(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), F.format_string("%02d", F.col("id") % 16)).alias("source"), F.floor(F.col("id") / 250).alias("day"))
    zones = sharding.zone_map(sharding.hilbert_shards(docs, 16, ["source", "day"]), ["source", "day"]).collect()
    touched = sum(z["min_source"] <= "s05" <= z["max_source"] for z in zones)
    assert len(zones) == 16 and touched <= 6


# quality


def test_features_are_finite(odd):
    for r in odd.collect():
        assert all(math.isfinite(x) for x in texts.features((r["text"] or "").encode()))


def test_gam_learns_features_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, len(texts.FEATURES)))
    y = (((x[:, 0] > 0.6) | ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5))) & (x[:, 1] < 0.9)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.9
    assert any({a, b} == {3, 7} for a, b, _ in model.pairs)
    total = model.base + sum(t[np.searchsorted(c, x[5, j], "right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    total += sum(t[np.searchsorted(model.pair_cuts[a], x[5, a], "right"), np.searchsorted(model.pair_cuts[b], x[5, b], "right")] for a, b, t in model.pairs)
    assert model.score(x[5:6])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def gam_by_hand(x, y):
    """The same boosting row by row; returns each row's score."""
    n, k = len(x), len(x[0])

    def cuts_of(values, bins):
        known = sorted(set(values))
        if len(known) < 2:
            return []
        at = {float(np.quantile(c, i / bins)) for c in (values, known) for i in range(1, bins)}
        places = sorted({min(max(sum(v < a for v in known), 1), len(known) - 1) for a in at})
        return [(known[i - 1] + known[i]) / 2 for i in places]

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def split(rows, bin_of, g, h):
        best, out = 1e-9, None
        for c in sorted({bin_of[i] for i in rows}):
            left, right = [i for i in rows if bin_of[i] < c], [i for i in rows if bin_of[i] >= c]
            if len(left) >= gam.LEAF and len(right) >= gam.LEAF:
                more = gain(left, g, h) + gain(right, g, h) - gain(rows, g, h)
                if more > best + 1e-12:
                    best, out = more, (c, left, right)
        return (best, *out) if out else None

    def grow(rows, bin_of, low, high, g, h, depth):
        """Value of each bin from low to high."""
        found = split(rows, bin_of, g, h) if depth else None
        if not found:
            return {b: sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1) for b in range(low, high)}
        _, c, left, right = found
        # empty bins between two groups go with the right one, as the first best place is taken
        c = max([bin_of[i] for i in left]) + 1
        return grow(left, bin_of, low, c, g, h, depth - 1) | grow(right, bin_of, c, high, g, h, depth - 1)

    bins = [[sum(c <= r[j] for c in cuts_of([q[j] for q in x], gam.BINS)) for r in x] for j in range(k)]
    size = [len(cuts_of([q[j] for q in x], gam.BINS)) + 1 for j in range(k)]
    rate = (sum(y) + 0.5) / (n + 1)
    total = [math.log(rate / (1 - rate))] * n
    for _ in range(gam.ROUNDS):
        for j in range(k):
            p = [1 / (1 + math.exp(-t)) for t in total]
            value = grow(range(n), bins[j], 0, size[j], [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p], 2)
            total = [t + gam.STEP * value[b] for t, b in zip(total, bins[j], strict=True)]
    return [1 / (1 + math.exp(-t)) for t in total]


def test_boosting_against_row_by_row(monkeypatch):
    monkeypatch.setattr(gam, "ROUNDS", 4)
    monkeypatch.setattr(gam, "PAIRS", 0)
    monkeypatch.setattr(gam, "BINS", 7)
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(size=(160, 4)), 2)
    y = ((x[:, 0] > 0.5) ^ (rng.uniform(size=160) < 0.15) | (x[:, 2] > 0.9)).astype(float)
    assert gam.fit(x, y).score(x) == pytest.approx(gam_by_hand(x.tolist(), y.tolist()), abs=1e-9)


def test_best_pair_of_cells_by_trial():
    """The cut along one side and across both halves that explains most."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        g, n = rng.normal(size=(4, 5)), rng.integers(0, 60, (4, 5))
        h = n * 0.2
        best = 0.0
        for G, H, N in ((g, h, n), (g.T, h.T, n.T)):
            for i in range(1, len(G)):
                total = -(g.sum() ** 2 / (h.sum() + 1))
                for rows in (slice(0, i), slice(i, None)):
                    a, b, c = G[rows].sum(0), H[rows].sum(0), N[rows].sum(0)
                    options = [a.sum() ** 2 / (b.sum() + 1)]
                    options += [a[:j].sum() ** 2 / (b[:j].sum() + 1) + a[j:].sum() ** 2 / (b[j:].sum() + 1) for j in range(1, len(a)) if c[:j].sum() >= gam.LEAF and c[j:].sum() >= gam.LEAF]
                    total += max(options)
                best = max(best, total)
        assert gam._quadrants(g, h, n)[0] == pytest.approx(best)


def test_gam_on_odd_documents(odd, none, labels):
    model = gam.train(odd, labels)
    got = gam.score(odd, model, ["doc_id", "kept", "score"]).select("kept.doc_id", "kept.score", F.col("score").alias("own")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect())
    assert all(0 <= r["own"] <= 1 and r["score"] == "s" for r in got)
    assert gam.score(none, gam.train(none, labels), ["doc_id"]).count() == 0
    assert gam.train(odd, labels.limit(0)).score(np.zeros((1, len(texts.FEATURES))))[0] == pytest.approx(0.5)


def test_gam_never_learns_from_the_held_out(odd, labels):
    flipped = labels.withColumn("quality", F.when(texts.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = gam.train(odd, labels), gam.train(odd, flipped)
    assert a.base == b.base and all((s == t).all() for s, t in zip(a.tables, b.tables, strict=True))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    scored = gam.score(docs, gam.train(docs, labels), ["doc_id"]).select("kept.doc_id", "score").join(labels, "doc_id").where(texts.held_out("doc_id")).collect()
    assert len(scored) > 60 and np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in scored]) > 0.93


# rules


def base_by_hand(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_documents(odd, none, labels):
    got = rules.judge(odd, labels).collect()
    want = Counter()
    for r in odd.collect():
        counts = base_by_hand(r["text"] or "")
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want[(r["doc_id"], *counts, failed)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["base_failed"] and r["kept"] for r in got)
    assert rules.judge(none, labels).count() == 0 and rules.judge(odd, labels.limit(0)).count() == odd.count()


def test_binomial_tail_and_cutoff():
    for k, n, p in ((0, 50, 0.1), (3, 20, 0.2), (20, 20, 0.5), (5, 9, 0.01)):
        assert rules.tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    # 300 good documents, ten of them at step 40: rejecting none can be proved, rejecting ten can't
    assert rules.cutoff({0: 290, 40: 10}, 300, 0.02, 0.01) == 41
    assert rules.cutoff({0: 50}, 50, 0.02, 0.01) is None


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_queries_equal_sql(spark, folder):
    import duckdb

    from sitemill.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{folder}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, f"/root/testdata/{folder}"), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())


def test_cutoffs_of_several_strata_equal_sql(spark, tmp_path):
    """Where rules act: two languages with enough labels, one without."""
    import duckdb

    from sitemill.llm import rules_sql

    rng = random.Random(4)
    rows = []
    for i in range(4200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(12, 30))]
        if i % 40 == 0:
            words += ["###"] * rng.randint(1, 60)
        if i % 55 == 0:
            words = [w.upper() + "!" for w in words]
        rows.append((i, " ".join(words) + "\n" + ("same line\n" * (i % 7 if i % 60 == 0 else 0)), ["en", "de", "xx"][0 if i < 2000 else 1 if i < 4000 else 2]))
    labels = [(i, int(i % 40 != 0 and i % 55 != 0 or i % 11 == 0)) for i in range(4200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "l"))
    docs, marked = spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "l"))
    stats = rules.count_texts(docs, ["doc_id"]).select("kept.doc_id", "stratum", *rules.COUNTS)
    assert {s for s, _ in rules.calibrate(stats, marked)} == {"en", "de"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.sql(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l/*.parquet'")
    got, want = rules.judge(docs, marked), con.sql(rules_sql.SQL)
    rejected = got.where("NOT base_failed AND NOT kept").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").count().collect()
    assert {r["lang"] for r in rejected} == {"en", "de"}
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_cutoffs_need_proof_in_each_stratum(spark):
    text = "good words in a fine line of text that goes on here "
    rows = [(i, "en", text + str(i)) for i in range(3000)] + [(3000 + i, "xx", text + str(i)) for i in range(20)] + [(4000 + i, s, "### " * 30 + " ".join(f"w{i}{k}" for k in range(40))) for i, s in enumerate(["en", "xx"])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3020)], "doc_id long, quality int")
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.judge(docs, labels).collect()}
    assert kept[4000] == (True, False) or not kept[4000][1]
    stats = rules.count_texts(docs, ["doc_id"]).select("kept.doc_id", "stratum", *rules.COUNTS)
    assert {s for s, _ in rules.calibrate(stats, labels)} == {"en"}


# SimHash


def fingerprint_by_hand(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return {frozenset(g) for g in groups.values()}


def test_simhash_on_odd_documents(odd, none):
    rows = odd.collect()
    prints = [fingerprint_by_hand(r["text"] or "") for r in rows]
    groups = closure(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    want = Counter()
    for g in groups:
        ids = [rows[i]["doc_id"] for i in g if rows[i]["doc_id"] is not None]
        for i in g:
            want[rows[i]["doc_id"], f"{prints[i]:016x}", min(ids) if ids else None] += 1
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def near_prints(rng, n):
    out = set()
    for _ in range(n):
        x = int(rng.integers(1 << 62)) * 2 + 1
        out.add(x)
        for flips in (1, 2, 3, 4, 5):
            y = x
            for b in rng.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            out.add(y)
    return sorted(out)


def test_links_join_what_all_pairs_join(spark):
    prints = near_prints(np.random.default_rng(3), 60)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    mask = (1 << 64) - 1
    want = closure(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & mask).bit_count() <= 4])
    assert closure(signed, [(r["a"], r["b"]) for r in found]) == want


def test_dense_points_join_as_balls_do(monkeypatch):
    """At a point of very many, cells of the free block stand for rows."""
    rng = np.random.default_rng(4)
    mask, places, (shift, bits) = simhash.PAIRS[0]
    point = int(rng.integers(1 << 62)) & mask
    fps = set()
    for _ in range(60):
        c = int(rng.integers(1 << bits))
        for _ in range(6):
            near = c ^ (1 << int(rng.integers(bits))) ^ (1 << int(rng.integers(bits)))
            fps.add(point ^ (0 if rng.random() < 0.5 else 1 << int(rng.choice(places))) | near << shift)
    fps = np.array(sorted(fps), np.uint64)
    ints = fps.tolist()
    off = [((x ^ point) & mask).bit_count() for x in ints]
    ball = [(ints[i], ints[j]) for i in range(len(ints)) for j in range(i) if ((ints[i] ^ ints[j]) >> shift & (1 << bits) - 1).bit_count() <= (2 - off[i]) + (2 - off[j])]
    a, b = simhash._dense(fps, point, mask, (shift, bits))
    assert closure(ints, zip(a.tolist(), b.tolist(), strict=True)) == closure(ints, ball)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (-5, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(g) for g in closure({x for e in edges for x in e}, edges) for n in g}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_is_split_in_the_join(spark):
    """Spark splits a hot key only between plain exchanges."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = simhash.Scratch().write(spark.range(40_000).repartition(8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("u"), F.col("id").alias("v")), "hub")
        joined = simhash._joined_by(edges, edges.groupBy("u").agg(F.min("v").alias("m")))
        assert joined.where("u = 7").agg(F.min("m"), F.max("m"), F.count("*")).first() == (0, 0, 13_335)
        joined.write.format("noop").mode("overwrite").save()
        rows = joined.collect()
        assert len(rows) == 40_000 and "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_points_are_made_by_many_tasks(spark):
    """Few small partitions of fingerprints don't make all points."""
    few = spark.createDataFrame([(i,) for i in range(1000)], "fp long").groupBy("fp").count().select("fp")
    plan = simhash.links(few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2


# suffix arrays


def test_two_stage_order_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(80):
        data = rng.choice(rng.choice([[97], [97, 98], [0, 255, 7], list(range(256))][int(rng.integers(4))], 8), int(rng.integers(1, 200))).astype(np.uint8)
        raw, order = data.tobytes(), suffixarray.two_stage(data, 10_000)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), suffixarray.common_prefixes(data, order, 24).tolist(), strict=True):
            same = 0
            while same < min(24, len(raw) - max(a, b)) and raw[a + same] == raw[b + same]:
                same += 1
            assert n == same
    assert len(suffixarray.two_stage(np.zeros(0, np.uint8), 4)) == 0


def removed_by_hand(texts_, length):
    raws = [t.encode() for t in texts_]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), bytes(np.frombuffer(r, np.uint8)[gone[:-1] == 0])))
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize(("length", "passage"), [(400, None), (64, None), (400, 200), (64, 48)])
def test_removal_on_odd_documents(odd, none, length, passage, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(suffixarray, "MOST_REGIONS", 1)
    rows = odd.collect()
    raws = [r["text"] or "" for r in rows]
    marked = [x[1] for x in removed_by_hand(raws, passage)] if passage else [None] * len(rows)
    want = Counter((r["doc_id"], *x, m) for r, x, m in zip(rows, removed_by_hand(raws, length), marked, strict=True))
    got = suffixarray.remove_repeats(odd, length=length, passage=passage, keep=["lang", "cid", "row"]).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["passage_bytes"] if passage else None) for r in got) == want
    assert all(r["cid"] == "c" and r["row"] == "r" for r in got)
    assert suffixarray.remove_repeats(none, length=length, passage=passage).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_passages_up_to_the_end_of_a_text(spark, hot, monkeypatch):
    """Strings that differ behind a shorter repeat, or end there."""
    if hot:
        monkeypatch.setattr(suffixarray, "MOST_REGIONS", 1)
        monkeypatch.setattr(suffixarray, "BLOCK", 3)
    rng = np.random.default_rng(5)

    def prose(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    passages = [prose(int(n)) for n in (210, 330, 405, 900, 399, 400)]
    rows = [prose(int(rng.integers(0, 500))) + passages[i % 6][int(rng.integers(0, 9)) :] + (prose(int(rng.integers(0, 500))) if i % 3 else "") for i in range(48)]
    got = suffixarray.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), passage=200).collect()
    want = {i: (*x, m[1]) for i, (x, m) in enumerate(zip(removed_by_hand(rows, 400), removed_by_hand(rows, 200), strict=True))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["passage_bytes"]) for r in got} == want
    with pytest.raises(ValueError):
        suffixarray.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=100, passage=200)


def test_digest_and_text_of_what_is_kept(odd):
    digests = Counter(r["kept_sha256"] for r in suffixarray.remove_repeats(odd, "digest").collect())
    rows = odd.collect()
    assert digests == Counter(hashlib.sha256(x[3]).hexdigest() for x in removed_by_hand([r["text"] or "" for r in rows], 400))
    assert all(isinstance(r["kept_text"], str) for r in suffixarray.remove_repeats(odd, "text").collect())


# sentences


def test_sentences_join_to_their_text(odd):
    for r in odd.collect():
        parts, words = sentences.sentences(r["text"] or "")
        assert "".join(parts) == (r["text"] or "") and max(words, default=0) <= sentences.LONG


def words_by_hand(text):
    """Runs between ASCII white space, each character of a script without spaces for itself."""
    out = [""]
    for c in text:
        alone = any(a <= c <= b for a, b in re.findall("(.)-(.)", sentences.UNSPACED))
        if alone or c in " \t\n\v\f\r":
            out += [c, ""] if alone else [""]
        else:
            out[-1] += c
    return [w for w in out if w]


def sentences_by_hand(text):
    out = []
    for part in re.findall(sentences.PATTERN, text):
        words = words_by_hand(part)
        if len(words) <= sentences.LONG:
            out.append(part)
            continue
        at, held, before, rest = 0, 0, None, part
        for w in words:
            cut = held and (held == sentences.LONG or (31 * ord(w[0]) + 17 * ord(before[-1]) + 7 * len(w) + 3 * len(before)) % sentences.RATE == 0)
            k = rest.index(w, at)
            if cut:
                out.append(rest[:k])
                rest, k, held = rest[k:], 0, 0
            at, held, before = k + len(w), held + 1, w
        out.append(rest)
    return out


def runs_by_hand(parts, least=20):
    """(first, end) of the fewest sentences, two at least, from each that hold ``least`` words."""
    out = []
    for i in range(len(parts)):
        for j in range(i + 2, len(parts) + 1):
            if sum(len(words_by_hand(p)) for p in parts[i:j]) >= least:
                out.append((i, j))
                break
    return out or ([(0, len(parts))] if len(parts) > 1 else [])


def removed_runs_by_hand(rows, least=20):
    """What becomes of each (doc_id, text)."""
    rows = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, hashlib.md5((r["text"] or "").encode()).digest(), r["text"] or "") for r in rows})
    first, out = set(), {}
    for has, i, _, text in rows:
        whole = sentences_by_hand(text)
        parts = [p.strip(" \n\t\r") for p in whole]
        gone = set()
        for a, b in runs_by_hand(parts, least):
            if tuple(parts[a:b]) in first:
                gone |= set(range(a, b))
            first.add(tuple(parts[a:b]))
        out[i if has else None, text] = (len(parts), len(gone), "".join(p for k, p in enumerate(whole) if k not in gone))
    return out


def test_repeated_runs_on_odd_documents(odd, none):
    want = removed_runs_by_hand(odd.where("length(text) < 60000 OR text IS NULL").collect())
    small = odd.where("length(text) < 60000 OR text IS NULL")
    got = sentences.remove_repeated_runs(small).collect()
    assert Counter(tuple(r) for r in got) == Counter((r["doc_id"], *want[r["doc_id"], r["text"] or ""]) for r in small.collect())
    assert sentences.remove_repeated_runs(odd).count() == odd.count()
    assert sentences.remove_repeated_runs(none).count() == 0


@pytest.mark.parametrize("n_docs", [100, 300, 900])
def test_shared_passages_go_and_clean_texts_stay(spark, n_docs):
    """Passages of over 50 words, of few or many sentences, anywhere in a text."""
    rng = np.random.default_rng(n_docs)

    def prose(n, sentence):
        words, left = [], 0
        for _ in range(n):
            left = left or int(rng.integers(1, sentence))
            left -= 1
            words.append(f"w{rng.integers(1 << 30)}" + ("." if left == 0 else ""))
        return words

    passages = [[*prose(50, int(rng.choice([4, 12, 20]))), "end", "here."] for _ in range(n_docs // 20)]
    rows, holds, seen = [], set(), set()
    for i in range(n_docs):
        words = prose(int(rng.integers(30, 300)), int(rng.choice([3, 12, 20])))
        if i % 20 == 1:
            words[len(words) // 2 :] = ["again"] * int(rng.integers(52, 90))
            if i > 20:
                holds.add(i)
        elif i % 2:
            k, at = int(rng.integers(len(passages))), int(rng.integers(len(words)))
            words[at:at] = passages[k]
            if k in seen:
                holds.add(i)
            seen.add(k)
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["n_removed"] for r in sentences.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught, clean = np.mean([got[i] > 0 for i in holds]), np.mean([got[i] == 0 for i in range(0, n_docs, 2)])
    print(f"{n_docs} documents: passages caught {caught:.3f}, clean texts left alone {clean:.3f}")
    assert caught >= 0.95 and clean == 1


def planted(spark, passage, place, n=40):
    """Texts of their own with a passage at a different place in each; the
    share of later ones that lose anything, and of texts without it that do not."""
    rows = [(i, place(i, passage)) for i in range(n)] + [(n + i, place(i + n, "")) for i in range(n)]
    got = {r["doc_id"]: r["n_removed"] for r in sentences.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught, clean = np.mean([got[i] > 0 for i in range(1, n)]), np.mean([got[n + i] == 0 for i in range(n)])
    print(f"caught {caught:.3f}, clean texts left alone {clean:.3f}")
    return caught, clean


@pytest.mark.parametrize("seed", range(4))
def test_passages_without_stops_are_found_at_any_place(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    caught, clean = planted(spark, passage, lambda i, p: " ".join([*(word() for _ in range(30 + i)), p, *(word() for _ in range(50))]))
    assert caught >= 0.95 and clean == 1


@pytest.mark.parametrize(("stop", "first", "n"), [("。", 0x4E00, 3000), ("！", 0x3041, 80), ("", 0x4E00, 3000), (" ", 0x0E01, 46)])
def test_scripts_without_spaces(spark, stop, first, n):
    """A sentence of 120 characters, twice in each text, among others of 20 to 40."""
    rng = random.Random(n)
    text = lambda k: "".join(chr(first + rng.randrange(n)) for _ in range(k))
    passage = text(120) + stop
    caught, clean = planted(spark, passage, lambda i, p: "".join([*(text(rng.randint(20, 40)) + stop for _ in range(i % 7 + 2)), p, text(30) + stop, p, text(25)]))
    assert caught == 1 and clean == 1


def test_no_run_is_one_sentence(odd):
    texts = [r["text"] or "" for r in odd.collect()] + ["word " * 100, "x. " * 100, "中" * 100, "One sentence alone", "a" * 5000]
    for t in texts:
        _, words = sentences.sentences(t)
        assert all(b - a >= 2 for least in (1, 20) for a, b in sentences.runs(words, least))


# media


def feature_by_hand(payload):
    x = [b - 128 for b in payload]
    n, pairs = len(x), list(zip(x, x[1:], strict=False))
    return f"n={n};mean={sum(x) / n:.4f};rms={(sum(v * v for v in x) / n) ** 0.5:.4f};peak={max(map(abs, x))};zcr={sum((a >= 0) != (b >= 0) for a, b in pairs) / n:.6f};step={sum(abs(b - a) for a, b in pairs) / n:.4f}"


def test_media_of_odd_documents(odd, none):
    got = media.media_features(odd).collect()
    want, streams = Counter(), Counter()
    stored = Counter((r["doc_id"], r["n_bytes"], len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in media.encode_media(odd).collect())
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), feature_by_hand(full)] += 1
        one = flac.encode([full])[0]
        streams[r["doc_id"], len(raw), len(one), hashlib.sha256(one).hexdigest()] += 1
    assert Counter((*tuple(r)[:5], r["feature"]) for r in got) == want
    assert Counter((r["doc_id"], r["n_bytes"], r["media_bytes"], r["media_sha256"]) for r in got) == streams == stored
    assert media.media_features(none).count() == 0


def test_media_are_stored_and_read_back(odd, spark):
    """A damaged file in the shared folder is found out."""
    stored = media.materialize(media.encode_media(odd), "test")
    assert sum(len(r["media"]) for r in spark.read.parquet(stored.cut_path).collect()) > 0
    hurt = stored.withColumn("media", F.expr("overlay(media PLACING X'00' FROM octet_length(media) - 40)"))
    with pytest.raises(Exception, match="FlacError"):
        media.features(hurt).collect()


def test_long_streams_need_memory_for_their_samples(monkeypatch):
    import tracemalloc

    raw = np.random.default_rng(3).choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 192 * 60_000).tobytes()
    tracemalloc.start()
    one = flac.encode([raw])[0]
    up = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    back = flac.decode([one])[0]
    down = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (back.samples[0] + 128).astype(np.uint8).tobytes() == raw
    print(f"memory for each byte of a text of {len(raw)} bytes: encoding {up / len(raw):.1f}, decoding {down / len(raw):.1f}")
    assert max(up, down) < 40 * len(raw)
    part = raw[: 192 * 200]
    whole = flac.encode([part, part[:384]])
    monkeypatch.setattr(flac, "LANES", 7)
    assert flac.encode([part, part[:384]]) == whole
    assert [(x.samples[0] + 128).astype(np.uint8).tobytes() for x in flac.decode(whole)] == [part, part[:384]]


def test_blocks_seek_and_join(odd, spark):
    stored = media.encode_media(odd.where("doc_id >= 10"))
    held = {r["doc_id"]: r for r in stored.collect()}
    blocks = defaultdict(dict)
    for r in media.pcm_blocks(stored.union(spark.createDataFrame([(None, 0, None)], stored.schema))).collect():
        blocks[r["doc_id"]][r["sample_offset"]] = (r["n_samples"], r["pcm"])
    for i, parts in blocks.items():
        at, pcm = 0, b""
        for offset in sorted(parts):
            assert offset == at
            at += parts[offset][0]
            pcm += parts[offset][1]
        back = (np.frombuffer(pcm, np.int8).astype(int) + 128).astype(np.uint8).tobytes()
        assert back.rstrip(b" ") == next(r["text"] for r in odd.collect() if r["doc_id"] == i).encode().rstrip(b" ")
        first, samples = flac.decode_from(bytes(held[i]["media"]), at - 1)
        assert first <= at - 1 < first + samples.shape[1]


def test_streams_of_every_shape_and_damage():
    rng = np.random.default_rng(2)
    t = np.arange(1152 * 2 + 192)
    payloads = [bytes([9]) * 192, rng.integers(0, 256, 1152 * 3, dtype=np.uint8).tobytes(), (128 + 60 * np.sin(t / 9) + rng.normal(0, 2, len(t))).astype(np.uint8).tobytes(), bytes(range(192)), (b"the of and " * 200)[:1344]]
    raws = flac.encode(payloads)
    kinds = set()
    for raw, p, stream in zip(raws, payloads, flac.decode(raws), strict=True):
        assert (stream.samples[0] + 128).astype(np.uint8).tobytes() == p
        info = flac.read_info(raw)
        kinds |= {raw[flac._header(raw, info.first + o, info, 0).data] >> 1 for _, o, _ in info.points}
        # without its seek table a stream is read frame by frame
        bare = raw[:4] + bytes([0x80]) + raw[5:42] + raw[info.first :]
        assert (flac.decode([bare])[0].samples == stream.samples).all()
    assert {0, 1} <= kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)
    raw = raws[2]
    for at in (len(raw) - 1, len(raw) - 400, flac.read_info(raw).first + 2):
        with pytest.raises(flac.FlacError):
            flac.decode([raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :]])
    with pytest.raises(flac.FlacError):
        flac.decode([raw[:-9]])
