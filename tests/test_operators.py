"""Rules on hand-made rows, brute-force comparisons, and entities that span many slices."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import time as tm
from cuewright.operators import alignment as al
from cuewright.operators import frames as fr
from cuewright.operators import gates
from cuewright.operators import intervals as iv
from cuewright.operators import segmentation as sg
from cuewright.operators import social as so
from cuewright.operators.greedy import blocks, chain
from cuewright.operators.quantiles import quantiles
from cuewright.operators.slices import Layout, lags, neighbours, position, running, top_rows
from cuewright.sources import logs, sinks, transcripts


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 else f"k{i % 5}", i, None if rng.random() < 0.3 else rng.randint(0, 50)) for i in range(600)]
    return spark.createDataFrame(data, "media_id string, seq bigint, v bigint"), data


def test_running_and_neighbours_cross_slices(numbers):
    df, data = numbers
    layout = Layout(("media_id",), ("seq",), 16)
    got = running(df, layout, {"total": ("sum", "v"), "top": ("max", "v"), "seen": ("last", "v"), "coming": ("first_after", "v")})
    got = neighbours(got, layout, lag={"before": "v"}, lead={"after": "v"})
    got = position(got, layout, "pos")
    by = {}
    for k, s, v in data:
        by.setdefault(k, []).append((s, v))
    for r in got.collect():
        seq = sorted(by[r["media_id"]])
        i = [s for s, _ in seq].index(r["seq"])
        past = [v for _, v in seq[: i + 1] if v is not None]
        rest = [v for _, v in seq[i:] if v is not None]
        assert r["pos"] == i
        assert (r["total"] or 0) == sum(past)
        assert r["top"] == (max(past) if past else None)
        assert r["seen"] == (past[-1] if past else None)
        assert r["coming"] == (rest[0] if rest else None)
        assert r["before"] == (seq[i - 1][1] if i else None)
        assert r["after"] == (seq[i + 1][1] if i + 1 < len(seq) else None)


def test_lags_cross_short_slices(numbers):
    df, data = numbers
    got = lags(df, Layout(("media_id",), ("seq",), 4), "v", 3).collect()
    by = {}
    for k, s, v in data:
        by.setdefault(k, []).append((s, v))
    for r in got:
        seq = sorted(by[r["media_id"]])
        i = [s for s, _ in seq].index(r["seq"])
        want = [seq[i - j][1] if i >= j else None for j in (1, 2, 3)]
        assert [r["lag_1"], r["lag_2"], r["lag_3"]] == want


def test_chain_matches_walk_over_small_chunks(spark):
    rng = random.Random(3)
    data, want = [], {}
    for k, n in (("a", 500), ("b", 30), ("c", 1)):
        nxt = [i + rng.randint(1, 9) for i in range(n)]
        data += [(k, i, nxt[i]) for i in range(n)]
        at, want[k] = 0, []
        while at < n:
            want[k].append(at)
            at = nxt[at]
    df = spark.createDataFrame(data, "clip_id string, id bigint, nxt bigint")
    starts = chain(df, ["clip_id"], chunk=16)
    got = {}
    for k, i in rows(starts, "clip_id", "id"):
        got.setdefault(k, []).append(i)
    assert got == want
    numbered = blocks(df.withColumnRenamed("id", "pos"), starts.withColumnRenamed("id", "pos"), ["clip_id"], chunk=16)
    assert numbered.filter("clip_id = 'a'").agg(F.max("block")).first()[0] == len(want["a"]) - 1


def test_quantiles_match_numpy(spark):
    import numpy as np

    rng = random.Random(5)
    data = [("g" if i % 4 else "h", rng.random() * 100) for i in range(5000)]
    df = spark.createDataFrame(data, "k string, v double")
    for accuracy in (100, 10_000):
        got = {r["k"]: (r["a"], r["b"]) for r in quantiles(df, ["k"], {"a": ("v", 0.9), "b": ("v", 0.15)}, accuracy).collect()}
        for k in "gh":
            v = [x for n, x in data if n == k]
            assert got[k] == pytest.approx((np.percentile(v, 90), np.percentile(v, 15)))


def test_top_rows_with_one_hot_key(spark):
    df = spark.range(1000).select(F.lit("x").alias("k"), "id")
    assert [r[1] for r in rows(top_rows(df, ["k"], [F.col("id").desc()], 3, salts=4), "rank")] == [999, 998, 997]


def test_debounce_keeps_from_last_kept(spark):
    df = spark.createDataFrame([("m", f) for f in (1, 3, 5, 9)], "media_id string, frame bigint")
    assert [r[1] for r in rows(fr.debounce(df, 3), "frame")] == [1, 5, 9]
    assert [r[1] for r in rows(fr.dedup_onsets(df, 3), "frame")] == [1, 9]


def test_interval_edges(spark):
    df = spark.createDataFrame([("m", 0.0, 5.0), ("m", 5.05, 6.0), ("m", 30.0, 31.0), ("m", 56.0, 57.0)], "media_id string, s double, e double")
    assert len(rows(iv.merge_overlaps(df, 0.05))) == 3
    assert len(rows(iv.merge_gaps(df, 25.0))) == 2
    assert len(rows(iv.merge_gaps(df, 24.0))) == 3
    whole = spark.createDataFrame([("m", 0.0, 100.0)], "media_id string, lo double, hi double")
    cuts = spark.createDataFrame([("m", 10.0, 20.0), ("m", 12.0, 15.0), ("m", 90.0, None)], "media_id string, s double, e double")
    assert [r[1:] for r in rows(iv.complement(cuts, whole), "s")] == [(0.0, 10.0), (20.0, 90.0)]


def test_keeps_and_cuts_tile_the_range(spark):
    rng = random.Random(11)
    cuts = [("m", float(s), float(s + rng.randint(1, 9))) for s in rng.sample(range(0, 900), 60)]
    c = spark.createDataFrame(cuts, "media_id string, s double, e double")
    whole = spark.createDataFrame([("m", 0.0, 1000.0)], "media_id string, lo double, hi double")
    kept = sum(e - s for _, s, e in rows(iv.complement(c, whole, layout=iv.timed(width=50.0))))
    cut = sum(r["e"] - r["s"] for r in iv.merge_overlaps(c, 0.0, iv.timed(width=50.0)).collect())
    assert kept + cut == pytest.approx(1000.0)
    merged = iv.merge_overlaps(c).drop("parts")
    assert rows(iv.merge_overlaps(merged).drop("parts"), "s") == rows(merged, "s")


def test_caption_gate_edges(spark):
    data = [
        ("c", 0, 0.0, 0.28, "abcdefghijklmnop", None, None),
        ("c", 1, 0.25, 2.0, "ok", None, None),
        ("c", 2, 1.96, 3.0, "ok ok", ["ok", "no"], [True]),
        ("c", 3, 5.0, 5.0, "", None, None),
        ("c", 4, 6.0, 7.0, "é é", None, None),
    ]
    df = spark.createDataFrame(data, "clip_id string, seq int, s double, e double, text string, w array<string>, em array<boolean>")
    got = {(r["seq"], r["code"]) for r in gates.caption_qc(df).collect()}
    assert got == {
        (0, "fast_opening_hook_review"), (2, "overlap"), (2, "repeated_word"), (2, "word_list_mismatch"),
        (2, "emphasis_length_mismatch"), (3, "empty_text"), (3, "invalid_time"), (4, "repeated_word"),
    }


def random_words(n, seed):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", "", ",", ".", " ?"])
        d = rng.random() * 0.5 + 0.05
        out.append((round(t, 3), round(t + d, 3), w.replace(" ", "")))
        t += d + rng.choice([0, 0, 0.1, 0.4])
    return out


def test_merge_captions_against_brute_force(spark):
    atoms = random_words(300, 2)
    df = spark.createDataFrame([("c", *a) for a in atoms], "clip_id string, s double, e double, text string")
    got = [(r["s"], r["e"], r["text"]) for r in sg.merge_captions(df, chunk=32).orderBy("seq").collect()]
    bare = lambda t: t.replace(" ", "")
    assert bare("".join(t for *_, t in got)) == bare("".join(t for *_, t in atoms))  # nothing lost, order kept
    starts, ends = {s: i for i, (s, _, _) in enumerate(atoms)}, {e: i for i, (_, e, _) in enumerate(atoms)}
    assert [starts[s] for s, _, _ in got] == [0, *(ends[e] + 1 for _, e, _ in got[:-1])]  # blocks of whole atoms, side by side
    assert all(len(t) <= max(18, len(t.split()[0])) for *_, t in got)
    for (s, e, t), (s2, e2, t2) in zip(got, got[1:]):  # the next word did not fit, came late, or would have taken too long
        first = atoms[starts[s2]]
        assert len(t + " " + first[2]) > 18 or s2 - atoms[ends[e]][1] >= 0.30 or first[1] - s >= 2.2 or e - s >= 2.2
    small = [(r["s"], r["e"], r["text"]) for r in sg.merge_captions(df, chunk=7).orderBy("seq").collect()]
    assert small == got


def test_rhythm_loses_no_text(spark):
    atoms = random_words(200, 4)
    df = spark.createDataFrame([("c", *a, 500.0) for a in atoms], "clip_id string, s double, e double, text string, total double")
    out = sg.caption_rhythm(df).orderBy("s").collect()
    assert " ".join(r["text"] for r in out).split() == " ".join(t for _, _, t in atoms).split()
    assert all(a["e"] <= b["s"] + 1e-9 for a, b in zip(out, out[1:]))


def test_rhythm_keeps_short_captions_after_silence(spark):
    rows = [("c", 0.0, 1.0, "oi", 20.0), ("c", 8.0, 8.1, "sim", 20.0), ("c", 8.1, 9.6, "x" * 30, 20.0), ("d", 0.0, 0.05, "a", 0.05), ("e", 1.0, 1.04, "b", 9.0), ("e", 1.04, 3.0, "y" * 29, 9.0)]
    df = spark.createDataFrame(rows, "clip_id string, s double, e double, text string, total double")
    out = {(r["clip_id"], w) for r in sg.caption_rhythm(df).collect() for w in r["text"].split()}
    assert out == {(r[0], r[3]) for r in rows}


def test_rhythm_in_stretches_equals_the_whole_clip(spark):
    rng = random.Random(12)
    rows = []
    for clip in range(6):
        t = 0.0
        for _ in range(80):
            d = rng.choice((0.05, 0.2, 0.5, 1.5, 2.5))
            rows.append((f"c{clip}", round(t, 3), round(t + d, 3), "x" * rng.choice((0, 1, 4, 12, 28, 31, 44)), 1000.0))
            t += d + rng.choice((0.0, 0.0, 0.1, 1.6, 3.0, 9.0))
    df = spark.createDataFrame(rows, "clip_id string, s double, e double, text string, total double")
    cut, whole = ({(r["clip_id"], round(r["s"], 6), round(r["e"], 6), r["text"]) for r in sg.caption_rhythm(df, cut=c).collect()} for c in (True, False))
    assert cut == whole


def test_highlights_match_one_by_one_choice(spark):
    rng = random.Random(9)
    words = [(f"c{c}", b, b * 3 + k, rng.choice("alpha beta gamma delta omega kappa sigma".split()), round(rng.random() * 5, 2)) for c in range(2) for b in range(60) for k in range(3)]
    df = spark.createDataFrame(words, "clip_id string, block bigint, seq bigint, word string, score double")
    got = {(r["clip_id"], r["seq"]) for r in sg.choose_highlights(df).collect()}
    want = set()
    for c in ("c0", "c1"):
        mine = [w for w in words if w[0] == c]
        best = {}
        for w in mine:
            if w[1] not in best or (w[4], -w[2]) > (best[w[1]][4], -best[w[1]][2]):
                best[w[1]] = w
        taken, used = [], set()
        for w in sorted((w for w in best.values() if w[4] >= 0.6), key=lambda w: (w[4], w[1], w[2]), reverse=True):
            if len(taken) >= max(1, round(60 / 2.7)):
                break
            if w[3] in used or any(abs(w[1] - t[1]) <= 1 for t in taken):
                continue
            taken.append(w)
            used.add(w[3])
        want |= {(c, w[2]) for w in taken}
    assert got == want


def test_token_diff_is_the_standard_ratio(spark):
    a, b = "um dois tres quatro".split(), "um dois quatro cinco".split()
    r = al.token_diff(spark.createDataFrame([(1, a, b)], "k int, a array<string>, b array<string>")).first()
    assert r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
    assert [op["tag"] for op in r["ops"]] == [o[0] for o in difflib.SequenceMatcher(None, a, b).get_opcodes()]


def plain_drop_overlapped(captions):
    out, held = [], None
    for s, e, text, flag in sorted(captions, key=lambda c: c[:3]):
        row = [s, e, text, flag]
        if held:
            a, b = (set(t.lower().split()) for t in (held[2], text))
            alike = len(a & b) / max(len(a | b), 1) >= 0.5 and (held[3] or flag)
            mine, its = ((c[1] - c[0]) / max(0.45, len(c[2]) / 20.0) for c in (held, row))
            if alike and min(mine, its) < 0.6:
                held = [min(held[0], s), max(held[1], e), *(held if mine >= its else row)[2:]]
                continue
            out.append(held)
        held = row
    return [tuple(c[:3]) for c in [*out, *([held] if held else [])]]


@pytest.mark.parametrize("chunk", [11, 40, 1 << 15])
def test_drop_overlapped_equals_one_sweep(spark, chunk):
    """Runs over many chunks, ties, repeated captions and mixed clips, whatever the chunk."""
    rng, clips = random.Random(4), {}
    for clip in ("a", "b", "c"):
        at = 0.0
        clips[clip] = []
        for _ in range(70):
            at += rng.choice([0.0, 0.01, 0.05, 2.0])
            clips[clip].append((round(at, 2), round(at + rng.choice([0.05, 0.2, 1.0]), 2), rng.choice(["one two", "one two three", "four", ""]), rng.random() < 0.7))
    clips["run"] = [(i * 0.01, i * 0.01 + 0.1, "same old words", True) for i in range(60)] + [(50.0, 52.0, "other", False)]
    df = spark.createDataFrame([(k, *c) for k, v in clips.items() for c in v], "clip_id string, s double, e double, text string, repaired boolean")
    got = al.drop_overlapped(df, chunk=chunk).orderBy("clip_id", "seq").collect()
    for clip, captions in clips.items():
        mine = [r for r in got if r["clip_id"] == clip]
        assert [r["seq"] for r in mine] == list(range(len(mine)))
        assert [(r["s"], r["e"], r["text"]) for r in mine] == plain_drop_overlapped(captions)


def test_drop_overlapped_run_of_100000(spark):
    data = [(i * 1e-4, i * 1e-4 + 1e-3, f"same old words {i % 7}", True) for i in range(100_000)]
    df = spark.createDataFrame([("a", *c) for c in data], "clip_id string, s double, e double, text string, repaired boolean")
    got = [(r["s"], r["e"], r["text"]) for r in al.drop_overlapped(df).orderBy("seq").collect()]
    assert got == plain_drop_overlapped(data)


def test_drop_overlapped_odd_rows(spark):
    kind = "clip_id string, s double, e double, text string, repaired boolean, seq int"
    df = spark.createDataFrame([("a", 0.0, 1.0, None, None, 1), ("a", None, 1.0, "x", True, 2), (None, 0.0, 1.0, "x", True, 3), (None, 0.0, 1.0, "x", True, 3)], kind)
    assert sorted(map(tuple, al.drop_overlapped(df).collect()), key=str) == [("a", 0, 0.0, 1.0, ""), (None, 0, 0.0, 1.0, "x"), (None, 1, 0.0, 1.0, "x")]
    assert al.drop_overlapped(df.limit(0)).count() == 0


def test_merge_captions_with_many_blank_rows(spark):
    data = [("a", 0.0, 0.001, "ab"), *[("a", i * 0.001, i * 0.001 + 0.001, "") for i in range(1, 70)], ("a", 0.07, 0.08, "cd"), ("a", 9.0, 9.5, "ef")]
    df = spark.createDataFrame(data, "clip_id string, s double, e double, text string")
    got, whole = (rows(sg.merge_captions(df, chunk=c), "seq") for c in (7, 1 << 16))
    assert got == whole and [r[2:4] for r in got] == [(0.0, 0.08), (9.0, 9.5)] and got[0][4].split() == ["ab", "cd"]


def test_greedy_captions_carry_many_words(spark):
    words = ["a"] * 40 + ["x" * 90, "end."]
    df = spark.createDataFrame([("c", i * 0.1, i * 0.1 + 0.1, w) for i, w in enumerate(words)], "clip_id string, s double, e double, word string")
    want = ["a", " ".join(["a"] * 39 + ["x" * 90]), "end."]
    for c in (5, 1 << 16):
        got = sg.greedy_captions(df, limit=100, sentence_limit=110, functions=frozenset("a"), chunk=c)
        assert [r["text"] for r in got.orderBy("s").collect()] == want


def test_drop_overlapped_keeps_the_roomier(spark):
    data = [("c", 0.0, 0.1, "tudo bem com você", True), ("c", 0.05, 1.5, "tudo bem com você aí", False), ("c", 4.0, 6.0, "outra", False)]
    df = spark.createDataFrame(data, "clip_id string, s double, e double, text string, repaired boolean")
    assert [(r["s"], r["e"], r["text"]) for r in al.drop_overlapped(df).orderBy("seq").collect()] == [(0.0, 1.5, "tudo bem com você aí"), (4.0, 6.0, "outra")]


def test_align_words_across_chunks(spark):
    rng = random.Random(1)
    asr = [("m", i, rng.choice("abcdefgh"), i * 1.0, i + 0.5) for i in range(200)]
    ref = [(m, k, s + 0.1, e) for m, i, k, s, e in asr if i % 4]
    ref = [("m", j, k, s, e) for j, (_, k, s, e) in enumerate(ref)]
    out = al.align_words(
        spark.createDataFrame(asr, "media_id string, pos bigint, k string, s double, e double"),
        spark.createDataFrame(ref, "media_id string, pos bigint, k string, s double, e double"), chunk=37,
    )
    got = [r["s"] for r in out.orderBy("pos").collect()]
    want, at = [], 0
    for _, _, k, s, _ in asr:
        m = next((i for i in range(at, min(at + 4, len(ref))) if ref[i][2] == k), None)
        want.append(s if m is None else ref[m][3])
        at = at if m is None else m + 1
    assert got == pytest.approx(want)


def test_superseded_takes(spark):
    data = [("m", 0.0, 2.0, "eu vou falar disso"), ("m", 10.0, 12.0, "Eu vou falar de novo"), ("m", 400.0, 402.0, "eu vou falar"), ("m", 410.0, 412.0, "nada a ver")]
    df = spark.createDataFrame(data, "media_id string, s double, e double, text string")
    assert [r["s"] for r in al.superseded_takes(df).collect()] == [0.0]


def test_timecodes(spark):
    r = spark.range(1).select(
        tm.to_seconds(F.lit("01:02:03,500")), tm.to_seconds(F.lit("2:05")), tm.to_seconds(F.lit("7.5")), tm.to_seconds(F.lit("00:00:01:15"), 30),
        tm.fps_ratio(F.lit("30000/1001")), tm.fps_ratio(F.lit("0/0")),
    ).first()
    assert tuple(r) == (3723.5, 125.0, 7.5, 1.5, 30000 / 1001, 0.0)


def test_srt_round_trip_and_tolerance(spark, tmp_path):
    cues = spark.createDataFrame([("a", i, i * 2.0, i * 2.0 + 1.25, f"fala {i}") for i in range(40)], "media_id string, seq bigint, s double, e double, text string")
    sinks.write_srt(cues, str(tmp_path / "srt"), files=3)
    parts = sorted((tmp_path / "srt" / "media_id=a").glob("part-*"))
    assert len(parts) > 1
    whole = "".join(p.read_text(encoding="utf-8") for p in parts)
    (tmp_path / "a.srt").write_text("﻿" + whole, encoding="utf-8")
    back = transcripts.read_srt(spark, str(tmp_path / "a.srt"))
    assert rows(back.select("s", "e", "text"), "s") == rows(cues.select("s", "e", "text"), "s")
    odd = "1\n00:00:01.000 --> 00:00:02.000\n\nx\n00:00:03,000 --> 00:00:04,500\n<b>a &amp; b</b>\n"
    (tmp_path / "odd.srt").write_text(odd, encoding="utf-8")
    assert rows(transcripts.read_srt(spark, str(tmp_path / "odd.srt"), tolerant=True).select("s", "e", "text")) == [(3.0, 4.5, "a & b")]


def test_feedback_append_and_read(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("2026-09-01", "c1", "corte", "texto", "s", None)], "date string, client string, category string, text string, skill string, action string")
    df = df.withColumn("date", F.col("date").cast("date"))
    sinks.append_feedback(df, path)
    sinks.append_feedback(df, path)
    assert logs.read_feedback(spark, path).count() == 2


def test_session_log_skips_broken_lines(spark, tmp_path):
    good = '{"type":"assistant","sessionId":"s","timestamp":"2026-01-01T00:00:0%d.000Z","message":{"usage":{"output_tokens":5},"content":[{"type":"tool_use","name":"Bash","input":{"command":"ls r1"}}]}}'
    (tmp_path / "s.jsonl").write_text("\n".join([good % 1, '{"type": "assis', '{"type":"user"}', good % 2]))
    got = logs.read_turns(spark, str(tmp_path / "s.jsonl"))
    assert [r["idx"] for r in got.orderBy("idx").collect()] == [0, 1]


def test_utf16_series_and_inventory(spark, tmp_path):
    from cuewright.sources import files

    (tmp_path / "v.csv").write_bytes("Views\n\n2026-09-01,10\n2026-09-02,12\n".encode("utf-16"))
    assert rows(files.read_daily_views(spark, str(tmp_path / "v.csv"), 2026).select("views"), "views") == [(10,), (12,)]
    (tmp_path / "lib").mkdir()
    for name in ("a.txt", ".DS_Store", "._b"):
        (tmp_path / "lib" / name).write_text("x")
    seen = files.scan_files(spark, [str(tmp_path / "lib")], hashes=True).collect()
    assert len(seen) == 1 and len(seen[0]["qhash"]) == 20


def test_streams_match_batch(spark, tmp_path):
    from cuewright.streaming import logs as st

    src = tmp_path / "in"
    src.mkdir()
    line = '{"ts":"2026-01-0%d 10:00:00","client":"c","category":"x"}\n'
    (src / "a.json").write_text("".join(line % d for d in (1, 1, 2)))
    stream = st.read_stream(spark, str(src), "ts timestamp, client string, category string", 1)
    st.run_to_folder(st.feedback_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    (src / "b.json").write_text(line % 9)
    st.run_to_folder(st.feedback_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_stream_caption_gate_runs_once_per_version(spark, tmp_path):
    from cuewright.streaming import logs as st

    src = tmp_path / "caps"
    src.mkdir()
    row = '{"clip_id":"c","hash":"h","seq":0,"s":0.0,"e":0.1,"text":"muito texto em pouco tempo"}\n'
    (src / "a.json").write_text(row)
    (src / "b.json").write_text(row)
    found = []
    q = st.caption_checks(st.read_stream(spark, str(src), st.CAPTION_ROWS, 1), lambda df, n: found.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r["code"] for r in found) == ["block_long", "cps_excessive", "too_short"]


def test_patterns_count_iso_weeks(spark):
    days = ["2024-01-02", "2024-12-30", "2024-12-31"]
    rows = [("p", d, "F", 10.0) for d in days] + [("p", "2024-06-01", "O", 1.0)] * 4
    posts = spark.createDataFrame(rows, "platform string, d string, format string, x double").withColumn("published_at", F.to_date("d"))
    got = {r["format"]: r for r in so.patterns(posts, ["format"], "x").collect()}
    assert (got["F"]["posts"], got["F"]["weeks"], got["F"]["pattern"]) == (3, 2, "consistent")
    assert so.cadence(posts, ["F"]).filter("iso_year = 2025 and week = 1 and F = 2").count() == 1


def test_level_frames_across_chunks(spark):
    from cuewright.sources import files

    samples = [((i * 37) % 101 - 50) * 100 for i in range(95)]
    chunks, at = [], 0
    for c, n in enumerate((40, 3, 0, 37, 15)):
        chunks.append(("m", c, samples[at : at + n]))
        at += n
    got = {r["frame"]: r["db"] for r in files.level_frames(spark.createDataFrame(chunks, "media_id string, chunk long, samples array<int>"), hop=10).collect()}
    assert sorted(got) == list(range(9))
    for f, db in got.items():
        ms = sum((x / 32768) ** 2 for x in samples[f * 10 : f * 10 + 10]) / 10
        assert abs(db - 20 * math.log10(math.sqrt(ms) + 1e-9)) < 1e-9


def test_new_assets_take_free_ids(spark):
    from cuewright.operators import catalog as ca

    old = spark.createDataFrame([("video-a-2", "x.mp4", "video", "h0", "x.mp4", ["t"], "")], "id string, name string, type string, qhash string, path string, tags array<string>, note string")
    new = spark.createDataFrame([(f"h{i}", f"d{i}/a.mp4", ["t"], "") for i in range(1, 5)], "qhash string, path string, tags array<string>, note string")
    got = sorted(r["id"] for r in ca.merge_assets(old, new)[0].collect())
    assert got == ["video-a", "video-a-2", "video-a-3", "video-a-4", "video-a-5"]


def test_licence_manifests(spark):
    lines = [
        ("a", 0, "\ufeffTitulo,arquivo,nota\r"), ("a", 1, '"x, ""y""",s1.wav,\r'), ("a", 2, "  "), ("a", 3, "x,s2.wav"), ("a", 4, '"x,s3.wav,'), ("a", 5, "x,,n"),
        ("b", 1, "s1.wav"), ("c", 0, "file"), ("c", 1, "S9.WAV"), ("c", 2, None), (None, 0, "file"),
    ]
    got = logs.parse_licences(spark.createDataFrame(lines, "manifest string, seq int, line string"))
    said = {(r.manifest, r.seq): (r.file, r.title, r.problem) for r in got.collect()}
    assert said == {
        ("a", 1): ("s1.wav", 'x, "y"', None), ("a", 3): ("s2.wav", "x", "fields"), ("a", 4): ("s3.wav", '"x', "quote"), ("a", 5): (None, "x", "file"),
        ("b", 1): (None, None, "header"), ("c", 1): ("S9.WAV", None, None),
    }
    uses = spark.createDataFrame([("S1.wav",), ("s2.wav",), ("s9.wav",), (None,)], "file string")
    assert {r.file for r in logs.unlicensed(uses, got).collect()} == {"s2.wav", None}


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("c", "k", "t", None, None)], "client string, category string, text string, skill string, action string")
    rows = rows.select(F.to_date(F.lit("2024-01-02")).alias("date"), "*")
    assert sinks.read_batches(spark, path).count() == 0
    assert sinks.append_batch(rows, path, "b-1") and not sinks.append_batch(rows, path, "b-1")
    (tmp_path / "log" / "_commits" / "b-2").write_text("")  # its writer died: not committed, may be tried again
    assert sinks.read_batches(spark, path).count() == 1
    assert sinks.append_batch(rows.limit(0).unionByName(rows), path, "b-2")
    assert sorted(r.batch for r in sinks.read_batches(spark, path).collect()) == ["b-1", "b-2"]
    with pytest.raises(ValueError):
        sinks.append_batch(rows, path, "../b")


def test_catalogue_snapshots(spark, tmp_path):
    path = str(tmp_path / "cat")
    one = spark.createDataFrame([(1, "sfx"), (2, None)], "id int, type string")
    assert sinks.catalog_version(spark, path) == 0 and sinks.save_catalog(one, path) == 1
    assert sinks.save_catalog(sinks.read_catalog(spark, path).filter("id = 1"), path, parent=1) == 2  # reads its own path
    with pytest.raises(sinks.StaleCatalogue):
        sinks.save_catalog(one, path, parent=1)
    (tmp_path / "cat" / "_versions" / f"{3:010d}").write_text("")  # a save that died
    assert sinks.catalog_version(spark, path) == 2 and sinks.save_catalog(one, path, parent=2) == 4
    assert sinks.read_catalog(spark, path).count() == 2 and sinks.read_catalog(spark, path, 2).count() == 1
    with pytest.raises(ValueError):
        sinks.read_catalog(spark, path, 3)


@pytest.mark.parametrize("lean", ["a", "b"])
def test_interval_join_of_all_lengths(spark, lean):
    """Pairs of intervals from milliseconds to years, some endless, backward or null, against all pairs."""
    rng = random.Random(11)

    def side(n):
        out = [("m", i, None, 5.0) for i in range(2)] + [("m", 2, 5.0, None), ("m", 3, 40.0, 30.0), ("m", 4, 100.0, math.inf), ("m", 5, 7.0, 7.0)]
        for i in range(6, n):
            s = round(rng.choice([rng.uniform(-500, 500), rng.uniform(0, 1e6), 10.0 * rng.randint(0, 90)]), 3)
            out.append((rng.choice(["m", "m", "other"]), i, s, round(s + rng.choice([0.4, 10.0, 40.0, 640.0]) * 4 ** rng.uniform(-2, 8), 3)))
        return out

    a, b = side(150), side(120)
    cols = "media_id string, i bigint, s double, e double"
    got = iv.interval_join(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), lean=lean)
    pairs = sorted((r["i"], r["b_i"], r["overlap"]) for r in got.collect())
    known = lambda x: x[2] is not None and x[3] is not None
    want = sorted(
        (x[1], y[1], min(x[3], y[3]) - max(x[2], y[2]))
        for x in a for y in b
        if x[0] == y[0] and known(x) and known(y) and x[2] < y[3] and x[3] > y[2] and min(x[3], y[3]) > max(x[2], y[2])
    )
    assert pairs == want and len(want) > 1000


def test_long_intervals_hang_in_few_cells(spark):
    """Three hours, in an even spread of starts: at most two cells a level."""
    df = spark.range(200).select((F.col("id") * 37.3).alias("s"), (F.col("id") * 37.3 + 10_800).alias("e"))
    every = F.array(*[F.sequence(F.lit(i), F.lit(iv.TOP)) for i in range(iv.TOP + 1)])
    copies = iv._hung(df, "s", "e", every, "_own", 10.0).groupBy("s", "_level").count().agg(F.max("count")).first()[0]
    assert copies <= 2
