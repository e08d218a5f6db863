"""How often operators read and move their rows, with brute-force comparisons on hand-made ones."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cuewright.operators import alignment as al
from cuewright.operators import clips as cl
from cuewright.operators import events as ev
from cuewright.operators import frames as fr
from cuewright.operators import intervals as iv
from cuewright.operators import packs as pk
from cuewright.operators import segmentation as sg
from cuewright.operators import words as wd
from cuewright.operators.greedy import blocks, chain
from cuewright.operators.quantiles import quantiles
from cuewright.operators.slices import Layout, neighbours, running


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted(spark, data, schema):
    """A relation and a counter of how many of its rows have been worked out."""
    seen = spark.sparkContext.accumulator(0)

    def see(r):
        seen.add(1)
        return r

    return spark.createDataFrame(spark.sparkContext.parallelize(data, 2).map(see), schema), seen


@pytest.fixture(scope="module")
def level(spark):
    rng = random.Random(3)
    data = [(m, i, float(rng.randint(-60, -5))) for m in ("a", "b", None) for i in range(400) if rng.random() < 0.9]
    return spark.createDataFrame(data, "media_id string, frame bigint, db double"), data


def test_slices_meet_their_summary_in_the_window(level):
    df, _ = level
    layout = Layout(("media_id",), ("frame",), 32)
    assert "Join" not in plan(neighbours(df, layout, lag={"p": "db"}, lead={"n": "db"}))
    assert "Join" not in plan(running(df, layout, {"after": ("first_after", "db")}))


def test_tail_check_copies_the_clips_not_the_words(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(cl, "interval_join", lambda a, b, *x, _real=cl.interval_join, **k: asked.append(k.get("lean", "b")) or _real(a, b, *x, **k))
    clips = spark.createDataFrame([(1, 1, 8.0), (2, 1, 20.0)], "clip_id bigint, media_id bigint, out double")
    words = spark.createDataFrame([(1, i * 0.4, i * 0.4 + 0.3) for i in range(40)], "media_id bigint, s double, e double")
    got = sorted(tuple(r) for r in cl.tail_check(clips, words).collect())
    assert asked == ["a"]
    assert [(r[0], r[2]) for r in got] == [(1, 7.9), (2, 20.0)]


def test_block_duplicates_in_one_pass(spark):
    rng = random.Random(5)
    data = [(m, i, rng.choice("abc"), i * 0.4) for m in (1, 2) for i in range(0, 600) if rng.random() < 0.9]
    words, seen = counted(spark, data, "media_id bigint, seq bigint, word string, s double")
    got = {tuple(r) for r in al.drop_block_duplicates(words, 60.0, 8.0, Layout(("media_id",), ("seq",), 7)).select("media_id", "seq").collect()}
    assert seen.value <= 3 * len(data)
    want = set()
    for m in (1, 2):
        w = [(q, k, s) for x, q, k, s in data if x == m]
        k = lambda i: w[i][1] if 0 <= i < len(w) else None  # noqa: B023, E731

        def pair(i):
            if i < 0:
                return False, False
            at = w[i][2]  # noqa: B023
            edge = round(at / 60) >= 1 and abs(at - round(at / 60) * 60) < 8
            same = edge and k(i) == k(i - 1)  # noqa: B023
            return same, edge and not same and i >= 2 and k(i) == k(i - 2) and k(i + 1) == k(i - 1)  # noqa: B023

        want |= {(m, w[i][0]) for i in range(len(w)) if not any(pair(i)) and not pair(i - 1)[1]}
    assert got == want


def test_near_frames_meet_one_pack(level):
    df, data = level
    asks = df.select("media_id", F.col("frame").alias("seq"))
    near = fr.near_frames(asks, df, F.greatest(F.col("seq") - 9, F.lit(0)), F.col("seq") + 5, 14, pack=16)
    assert plan(near).count("Aggregate") == 1  # the packs; picked frames are not gathered again
    for m, q, found in near.collect():
        want = [(i, db) for x, i, db in data if m is not None and x == m and max(q - 9, 0) <= i <= q + 5]
        assert [(f["frame"], f["db"]) for f in found] == want


def test_debounce_and_pingpong_read_their_input_twice(spark):
    rng = random.Random(9)
    cuts = [("a", i) for i in range(300) if rng.random() < 0.5]
    events, seen = counted(spark, cuts, "media_id string, frame bigint")
    got = [r.frame for r in fr.debounce(events, 3).orderBy("frame").collect()]
    want = []
    for _, i in cuts:
        if not want or i > want[-1] + 3:
            want.append(i)
    assert got == want and seen.value <= 2 * len(cuts)
    data = [("a", 10 * i, 10 * i + (9 if rng.random() < 0.8 else 90), rng.randint(0, 2)) for i in range(200)]
    shot, seen = counted(spark, data, "media_id string, f0 bigint, f1 bigint, level int")
    fr.pingpong(shot, 0.5).collect()
    assert seen.value <= len(data)


def test_label_overlaps_use_all_partitions(spark):
    rng = random.Random(4)
    data = [(f"p{i % 2}", i // 2 if i % 9 else None, float(rng.randint(1, 9) * 20), x := float(rng.randint(-90, 300)), x + rng.randint(0, 90)) for i in range(200)]
    labels = spark.createDataFrame(data, "panel string, id bigint, y double, x0 double, x1 double").coalesce(1)
    pairs = ev.label_overlaps(labels)
    got = sorted(tuple(r) for r in pairs.collect())
    want = sorted(
        (a[0], a[1], b[1]) for a in data for b in data
        if a[0] == b[0] and None not in (a[1], b[1]) and a[1] < b[1] and abs(a[2] - b[2]) < 44 and a[3] < b[4] - 8 and b[3] < a[4] - 8
    )
    assert got == want and got
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_clip_edges_read_the_words_once(spark):
    data = [(1, i, w, i * 0.4, i * 0.4 + 0.3) for i, w in enumerate("mas tudo isso foi bem dito hoje e nada mais se disse depois de".split() * 4)]
    words, seen = counted(spark, data, "media_id bigint, seq bigint, word string, s double, e double")
    clips = spark.createDataFrame([(7, 1, 0.0, 22.0, 22.0)], "clip_id bigint, media_id bigint, first_s double, last_e double, kept double")
    flags = {r.flag for r in cl.clip_edges(clips, words).collect()}
    assert {"opens_with_connective", "lower_case_opening", "duration_out_of_range"} <= flags
    assert seen.value == len(data)


def test_chains_of_many_entities_need_no_call_each(spark):
    """Whole batches of entities are solved in one Python call; a long one still spans chunks."""
    rng = random.Random(6)
    data = [(k, i, i + rng.randint(1, 5)) for k in [f"k{j}" for j in range(60)] for i in range(rng.randint(1, 9))]
    data += [("long", i, i + rng.randint(1, 5)) for i in range(300)] + [(None, 0, 1)]
    nodes = spark.createDataFrame(data, "k string, id bigint, nxt bigint")
    for chunk in (16, 1000, 1 << 60):
        found = chain(nodes, ["k"], chunk)
        assert chunk == 16 or "FlatMapGroupsInPandas" not in plan(found)
        want = set()
        for k in {r[0] for r in data} - {None}:
            step, at = {i: n for x, i, n in data if x == k}, 0
            while at in step:
                want.add((k, at))
                at = step[at]
        assert {tuple(r) for r in found.collect()} == want


def test_rules_and_rhythm_run_over_many_groups_at_once(spark, monkeypatch):
    """No operator groups clip by clip in pandas."""
    def never(*_, **__):
        raise AssertionError("a call for each clip")

    words = spark.createDataFrame([(f"c{c}", i, float(i), i + 0.3, "ab" * (1 + (c + i) % 4)) for c in range(40) for i in range(12)], "clip_id string, seq bigint, s double, e double, word string")
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", never)
    assert sg.base_blocks(words).count() == 480
    caps = sg.short_blocks(words).withColumn("total", F.lit(100.0))
    said = " ".join(r.text for r in sg.caption_rhythm(caps).orderBy("clip_id", "s").collect())
    assert len(said.split()) == 480
    assert sg.merge_captions(words.select("clip_id", "s", "e", F.col("word").alias("text"))).count() > 0


def test_blocks_meet_their_starts_without_a_join(spark):
    df = spark.createDataFrame([("a", i, "x") for i in range(50)] + [("b", i, "y") for i in range(3)] + [(None, 0, "z")], "k string, pos bigint, v string")
    starts = spark.createDataFrame([("a", 0), ("a", 7), ("a", 40), ("b", 0)], "k string, pos bigint")
    got = blocks(df, starts, ["k"], chunk=8)
    assert "Join" not in plan(got) and got.columns == ["k", "pos", "v", "block"]
    assert {tuple(r) for r in got.collect()} == {("a", i, "x", (i >= 7) + (i >= 40)) for i in range(50)} | {("b", i, "y", 0) for i in range(3)} | {(None, 0, "z", -1)}


def test_asof_moves_only_what_is_read(spark):
    """a column that the caller drops does not reach the shuffle."""
    left = spark.createDataFrame([(1, float(i), "w" * i) for i in range(20)], "media_id bigint, t double, word string")
    refs = spark.createDataFrame([(1, 3.0), (1, 11.0)], "media_id bigint, s double")
    got = iv.asof(left, refs, "t", "s", ["s"], name="r").select("t", F.col("r.s").alias("s"))
    window = plan(got).split("Window", 1)[1]
    assert "word" not in window.split("LogicalRDD")[0]
    assert {tuple(r) for r in got.collect()} == {(float(i), 3.0 if 3 <= i < 11 else 11.0 if i >= 11 else None) for i in range(20)}


def test_split_tokens_are_joined_in_one_move(spark):
    """only words beside a hyphen or percent token are gathered; results hold across slices."""
    rng = random.Random(8)
    data = [(m, i, rng.choice(["a", "b", "-c", "%"]) if m != 3 else "-c", i * 0.4, i * 0.4 + 0.3) for m in (1, 2, 3) for i in range(200) if rng.random() < 0.8]
    words = spark.createDataFrame(data, "media_id bigint, seq bigint, word string, s double, e double")
    want = []
    for m, q, w, s, e in data:
        if w[0] in "-%" and want and want[-1][0] == m:
            at = want[-1]
            want[-1] = (m, at[1], at[2] + w, at[3], max(at[4], e), at[5] + 1)
        else:
            want.append((m, q, w, s, e, 1))
    for width in (5, 1000):
        got = wd.join_split_tokens(words, Layout(("media_id",), ("seq",), width))
        assert sorted(tuple(r) for r in got.select("media_id", "seq", "word", "s", "e", "parts").collect()) == sorted(want)
    assert plan(got).count("Union") == 1


def test_token_diff_takes_a_few_rows_at_once(spark):
    """Arrow batches, no pandas frame of whole batches."""
    pairs = spark.createDataFrame([(i, ["a", "b", "c"], ["a", "c"]) for i in range(600)], "id bigint, a array<string>, b array<string>").coalesce(1)
    got = al.token_diff(pairs)
    assert "MapInArrow" in plan(got)
    found = got.collect()
    assert len(found) == 600 and {(round(r.ratio, 6), len(r.ops)) for r in found} == {(0.8, 3)}


def test_quantiles_rank_counted_values(spark):
    """Small groups need no sketch; large ones keep theirs."""
    rng = random.Random(2)
    data = [(k, float(rng.randint(0, 9)) if k == 1 else rng.random()) for k in (1, 2, None) for _ in range(400)]
    df = spark.createDataFrame(data, "k bigint, v double")
    for accuracy in (5000, 20):
        got = {r.k: (r.a, r.b) for r in quantiles(df, ["k"], {"a": ("v", 0.9), "b": ("v", 0.25)}, accuracy).collect()}
        for k in (1, 2, None):
            v = sorted(x for y, x in data if y == k)
            for q, found in zip((0.9, 0.25), got[k], strict=True):
                p = q * (len(v) - 1)
                assert abs(found - (v[int(p)] + (v[int(p) + 1] - v[int(p)]) * (p - int(p)))) < 1e-9
    assert "percentile_approx" not in plan(quantiles(df, ["k"], {"a": ("v", 0.9)}))


def test_unspoken_labels_gather_words_once(spark):
    """the words around a label are one text, not a row for each word and stem."""
    labels = spark.createDataFrame([(1, 1, 4.0, "Blaues Wasser"), (1, 2, 40.0, "roter Himmel"), (1, 3, 4.0, "ab")], "media_id bigint, label_id bigint, t double, text string")
    words = spark.createDataFrame([(1, "das", 3.0), (1, "Wasserfall", 5.0), (1, "er", 39.0), (1, "Him", 41.0), (1, "mel", 41.5)], "media_id bigint, word string, s double")
    got = ev.unspoken_labels(labels, words)
    assert "Generate explode(stem" not in plan(got) and plan(got).count("collect_set") == 1
    assert [r.label_id for r in got.collect()] == [2]


def test_other_voice_moves_words_of_its_recordings_only(spark):
    """F23"""
    sim = spark.createDataFrame([(m, i, 0.1 if m == 1 and 20 <= i < 40 else 0.9) for m in (1, 2) for i in range(60)], "media_id bigint, frame bigint, sim double")
    keep = spark.createDataFrame([(1, 0.0, 6.0), (2, 0.0, 6.0)], "media_id bigint, s double, e double")
    words = spark.createDataFrame([(m, i, i * 0.4, i * 0.4 + 0.3, f"w{i}") for m in (1, 2) for i in range(15)], "media_id bigint, seq bigint, s double, e double, word string")
    got = al.other_voice(sim, keep, keep, words)
    assert "LeftSemi" in plan(got)
    assert [(r.media_id, r.s, r.e, r.text) for r in got.collect()] == [(1, 2.0, 4.0, "w5 w6 w7 w8 w9")]


def test_copies_in_cells_are_not_broadcast(spark, tmp_path):
    """a written table is small on disk, its copies in the cells of the time tree are not."""
    spark.range(40).selectExpr("0L media_id", "id frame", "double(id % 9) db").write.parquet(str(tmp_path / "level"))
    level = spark.read.parquet(str(tmp_path / "level"))
    segs = level.groupBy("media_id", F.floor(F.col("frame") / 10).alias("k")).agg(F.min("frame").alias("f0"), (F.max("frame") + 1).alias("f1"))
    spans = [x.select("media_id", F.col("f0").cast("double").alias("s"), F.col("f1").cast("double").alias("e")) for x in (segs, segs)]
    pairs = iv.interval_join(*spans)
    assert "strategy=merge" in plan(pairs) and pairs.count() == 4
    got = fr.segment_p90(segs, level, ["k"], least=1)
    assert sorted((r.k, round(r.p90, 6)) for r in got.collect()) == [(0, 7.1), (1, 7.1), (2, 7.1), (3, 7.1)]


def test_segment_p90_copies_the_segments_not_the_frames(spark, monkeypatch):
    """F1"""
    asked = []
    monkeypatch.setattr(fr, "interval_join", lambda a, b, *x, _real=fr.interval_join, **k: asked.append(k.get("lean", "b")) or _real(a, b, *x, **k))
    level = spark.range(30).selectExpr("1L media_id", "id frame", "double(id) db")
    got = fr.segment_p90(spark.createDataFrame([(1, 7, 5, 15)], "media_id bigint, k bigint, f0 bigint, f1 bigint"), level, ["k"], pack=5, least=5)
    assert asked == ["a"] and [(r.k, round(r.p90, 6), round(r.lowest_piece, 6)) for r in got.collect()] == [(7, 13.1, 8.6)]


def test_join_loudness_broadcasts_no_copies(spark, level):
    """packs of frames and salted keys are merged; the frames of a splice stay where they are picked."""
    df, _ = level
    cuts = df.select("media_id", F.col("frame").alias("seq"), F.round(F.col("frame") * 0.01, 2).alias("t"))
    got = plan(fr.join_loudness(cuts, df, ["seq"]))
    assert "strategy=merge" in got and got.count("aggregate(filter(near#") == 2  # before and after, worked out once
    assert got.index("aggregate(filter(near#") < got.index("Join LeftOuter")
    assert plan(fr.attach(df, df.select("media_id").distinct(), ["media_id"])).count("strategy=merge") == 1


def test_packs_give_their_rows_back(spark):
    """Any text, number and null, in runs and apart; ordinary rows need no lists of texts."""
    rng = random.Random(7)
    big = [-(1 << 63), (1 << 63) - 1, 0, None]
    for texts, numbers in ((["a", "", "é", "x\ny"], range(9)), (["a", None], big), (["a\x1fb", "", "\x1f"], [*range(3), 1 << 62])):
        data = [(rng.choice([1, 2, None]), rng.choice(texts), rng.choice(list(numbers)), rng.choice([0.5, None])) for _ in range(300)]
        df = spark.createDataFrame(data, "k bigint, t string, n bigint, v double").coalesce(2)
        cols = ["t", "n", "v"]
        got = pk.packed(df, ["k"], cols)
        assert sorted(map(repr, map(tuple, pk.unpacked(got, cols).select("k", *cols).collect()))) == sorted(map(repr, data))
        assert got.filter("t_t is null").count() == (0 if texts[1] == "" and "\x1f" not in texts else got.count())
    run = pk.packed(spark.range(100).selectExpr("1 k", "id n").coalesce(1), ["k"], ["n"])
    assert [set(r.n_l) for r in run.collect()] == [{0}]


def test_kept_moves_its_rows_once(spark):
    """one shuffle of the words, in packs; sums over all kept intervals and over rows of one number."""
    rng = random.Random(8)
    word = lambda i: (s := rng.choice([i * 0.4, rng.uniform(0, 900), 1e5]), s + rng.choice([0.3, 0.02, 0.0, -1.0, 70.0, 5000.0, math.inf]))
    words = [(rng.choice([1, 1, 2, None]), rng.choice([i, i, 5, -i, None]), f"w{i}", *word(i)) for i in range(400)] + [(1, 900, "x", None, 5.0), (1, 901, "y", 5.0, None)]
    keep = [(m, s := rng.uniform(0, 900), s + rng.choice([0.02, 8.0, 300.0, math.inf, -4.0])) for m in (1, 1, 2, None) for _ in range(9)] + [(1, None, 9.0)]
    df = spark.createDataFrame(words, "media_id bigint, seq bigint, word string, s double, e double")
    kept = spark.createDataFrame(keep, "media_id bigint, s double, e double")
    got = iv.kept(df, kept, ["seq"])
    total = {}
    for m, q, _, s, e in words:
        for x, a, b in keep:
            if None not in (m, q, s, e, a, b) and m == x and s < b and e > a and min(e, b) > max(s, a):
                total[m, q] = total.get((m, q), 0.0) + min(e, b) - max(s, a)
    want = sorted((r for r in words if round(total.get((r[0], r[1]), 0.0), 6) > 0.03), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 100
    ran = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "LeftSemi" not in plan(got) and ran.count("MapInArrow") - ran.count("ReusedExchange") <= 1


def test_split_at_moves_packs_of_points(spark):
    """long and short intervals, repeated ids, null and equal times, points of every stretch; points travel in packs."""
    rng = random.Random(12)
    spans = [(rng.choice([1, 1, 2, None]), rng.choice([i, i, 3, None]), s := round(rng.uniform(-50, 9000), 1), s + rng.choice([0.05, 8.0, 200.0, 9000.0])) for i in range(60)]
    spans += [(1, 99, None, 5.0), (2, 98, 5.0, None), (1, 97, 60.0, 120.0), (1, 97, 60.0, 120.0)]
    points = [(rng.choice([1, 1, 2, None]), rng.choice([round(rng.uniform(-60, 9000), 1), 60.0 * rng.randint(0, 150), None])) for _ in range(900)]
    points += [(1, 60.04), (1, 119.96), (1, 90.0), (1, 90.0)]
    got = iv.split_at(
        spark.createDataFrame(spans, "media_id bigint, k bigint, s double, e double"), spark.createDataFrame(points, "media_id bigint, t double"), 0.04, ["k"]
    )
    marks = {}
    for m, k, s, e in spans:
        own = marks.setdefault((m, k), set())
        own |= {s, e}
        if m is not None and None not in (s, e) and s + 0.04 < e - 0.04:
            own |= {t for x, t in points if x == m and t is not None and s + 0.04 < t < e - 0.04}
    want = []
    for (m, k), own in marks.items():
        line = sorted(own, key=lambda t: (t is not None, t or 0.0))
        want += [(m, k, a, b) for a, b in zip(line, line[1:])]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 300
    assert plan(got).count("MapInArrow") >= 1 and "Window [row_number" not in plan(got)


def test_unspoken_labels_of_several_rows(spark):
    """rows of one label count together, null ids are never heard, no word without four letters travels."""
    rng = random.Random(13)
    texts = ["Blaues Wasser", "água fria", "ab cd", None, "Himmel Himmel rot", "éter"]
    said = ["das", "Wasserfall", "AGUAS", "him", "himme", "éteres", "x-fria9", None, "12345"]
    labels = [(rng.choice([1, 1, 2, None]), rng.choice([0.0, -0.0, 1.5, 7.0, None, float(i)]), rng.choice([4.0 * i, 90.0, None]), rng.choice(texts)) for i in range(120)]
    words = [(rng.choice([1, 2, None]), rng.choice(said), rng.choice([round(rng.uniform(0, 500), 1), 98.0, None])) for _ in range(160)]
    fold = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    stems = lambda x: {w[:5] for w in re.findall("[a-zà-ÿ]{4,}", (x or "").lower().translate(fold))}
    got = ev.unspoken_labels(
        spark.createDataFrame(labels, "media_id bigint, label_id double, t double, text string"), spark.createDataFrame(words, "media_id bigint, word string, s double")
    )

    def heard(m, k):
        own = [(t, x) for a, b, t, x in labels if a == m and b == k]
        near = [w.lower().translate(fold) for a, w, s in words if a == m and w and s is not None and any(t is not None and t - 8 < s < t + 8 for t, _ in own)]
        return any(stem in w for _, x in own for stem in stems(x) for w in near)

    want = {(m, k, t, x) for m, k, t, x in labels if stems(x) and (m is None or k is None or not heard(m, k))}
    plain = lambda rows: {repr((m, None if k is None else k + 0.0, t, x)) for m, k, t, x in rows}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) > 20 and plain(found) == plain(want)
    assert "RLIKE" in plan(got) and plan(got.select("label_id")).count("first(text") == 0


def test_text_in_moves_packs_of_words(spark):
    """intervals and words of all lengths, in and across cells, repeated names, nulls; words travel in packs."""
    rng = random.Random(14)
    length = lambda: rng.choice([0.3, 0.3, 0.0, -1.0, 8.0, 59.9, 60.0, 61.0, 300.0, 4000.0, math.inf])
    for longest, margin in ((60.0, 0.05), (math.inf, 0.0)):
        words = [(rng.choice([1, 1, 2, None]), i // 2, f"w{i}" if i % 11 else None, s := rng.choice([round(i * 0.4, 3), 60.0 * rng.randint(-2, 9), rng.uniform(-90, 900)]), s + min(length(), longest)) for i in range(400)]
        words += [(1, 900, "x", None, 5.0), (1, 901, "y", 5.0, None)]
        spans = [(rng.choice([1, 1, 2, None]), rng.choice([i, i, 3, None]), s := rng.choice([rng.uniform(-90, 900), 60.0 * rng.randint(-1, 9)]), s + length(), i) for i in range(80)]
        spans += [(1, 97, None, 5.0, 0), (1, 98, 5.0, None, 1), (1, 99, None, None, 2), (2, 99, 1e4, 1e4 + 1, 3), (2, 99, 100.0, 110.0, 4)]
        got = iv.text_in(
            spark.createDataFrame(spans, "media_id bigint, k bigint, s double, e double, extra int"),
            spark.createDataFrame(words, "media_id bigint, seq bigint, word string, s double, e double"), ["k"], margin,
        )
        said = {}
        for m, k, a, b, _ in spans:
            if None not in (m, k, a, b):
                a, b = a + margin, b - margin
                near = [(q, w is not None, w or "") for x, q, w, s, e in words if x == m and None not in (s, e) and s < b and e > a and min(e, b) > max(s, a)]
                said.setdefault((m, k), []).extend(near)
        want = [(m, k, a, b, x, " ".join(w for _, known, w in sorted(said.get((m, k), [])) if known)) for m, k, a, b, x in spans]
        assert got.columns == ["media_id", "k", "s", "e", "extra", "text"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "MapInArrow" in plan(got) and sum(len(r[5]) > 0 for r in want) > 30
