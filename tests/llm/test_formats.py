"""Reply trees, fill-in-middle and periodic runs against brute force, with their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.llm import fill_middle, periodic_runs, reply_trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- reply trees


def slow_paths(messages):
    """messages: id -> (parent, score). Root, leaf, mean score and path of every leaf."""
    up = {k: p if p in messages else None for k, (p, _) in messages.items()}
    leaves = set(messages) - {p for p in up.values() if p is not None}
    out = []
    for leaf in leaves:
        path = [leaf]
        while up[path[-1]] is not None:
            path.append(up[path[-1]])
        out.append((path[-1], leaf, sum(messages[k][1] for k in path) / len(path), path[::-1]))
    return out


def test_paths_of_reply_trees(spark):
    rng = random.Random(3)
    messages = {}
    for i in range(300):
        parent = None if i % 60 == 0 else rng.choice([i - 1, rng.randrange(i), i // 60 * 60, 10_000 if i % 97 == 0 else i - 1])
        messages[i] = (parent, round(rng.random(), 3))
    nodes = reply_trees.replies(spark.createDataFrame([(i, p, s, "user" if i % 2 else "assistant", f"t{i}") for i, (p, s) in messages.items()], "id long, parent long, score double, role string, text string"))
    want = {}
    for root, leaf, score, path in slow_paths(messages):
        want.setdefault(root, []).append((-score, f"i{leaf}", path))
    for branches in (1, 3):
        leaves, listed = reply_trees.paths(nodes, branches)
        chosen = {r.leaf: r for r in leaves.collect()}
        lines = {}
        for r in listed.collect():
            lines.setdefault(r.leaf, []).append((r.place, r.node))
        best = {leaf: (f"i{root}", k + 1, -score, path) for root, own in want.items() for k, (score, leaf, path) in enumerate(sorted(own, key=lambda x: (round(x[0], 9), x[1]))[:branches])}
        assert set(chosen) == set(best)
        for leaf, (root, rank, score, path) in best.items():
            assert (chosen[leaf].root, chosen[leaf]["rank"], chosen[leaf].n) == (root, rank, len(path)) and abs(chosen[leaf].score - score) < 1e-9
            assert [n for _, n in sorted(lines[leaf])] == [f"i{k}" for k in path] and [p for p, _ in sorted(lines[leaf])] == list(range(len(path)))


def test_conversations_of_a_long_thread_and_of_odd_messages(spark):
    n = 200
    nasty = ["\\### Assistant: </turn> ok", "####", "<\\/turn>", "a </turn>\n### user: b", "\\", "", None, "é😀 ##", " </turn>", "#", "##\\"]
    rows = [(i, i - 1 if i else None, 0.0, ["user", "assistant", "a: b\\", None, "x:"][i % 5], nasty[i % len(nasty)]) for i in range(n)]
    rows += [(500, 501, None, "user", "an answer to nothing"), (600, None, 0.5, "user", "first"), (600, None, 0.9, "user", "better"), (600, None, 0.9, "user", "better"), (None, 600, 0.1, "assistant", "no id"), (None, 600, 0.1, "assistant", "no id"), (None, None, 0.0, None, None)]
    made = reply_trees.conversations(reply_trees.replies(spark.createDataFrame(rows, "id long, parent long, score double, role string, text string")), branches=5, block=7)
    read = made.select("root", "n_turns", "formatted", "loss", reply_trees.parsed(F.col("formatted")).alias("turns"), reply_trees.under_mask(F.col("formatted"), F.col("loss")).alias("learnt")).collect()
    by_root = {}
    for r in read:
        by_root.setdefault(r.root, []).append(r)
    long = by_root["i0"][0]
    assert [(t.role, t.text) for t in long.turns] == [(r or "", t or "") for _, _, _, r, t in rows[:n]] and long.n_turns == n
    assert long.learnt == "".join(t or "" for _, _, _, r, t in rows[:n] if r == "assistant") and len(long.loss) == n // 5
    assert long.formatted.count("</turn>") == n and long.formatted.count("###") == n
    assert [(t.role, t.text) for t in by_root["i600"][0].turns] == [("user", "better"), ("assistant", "no id")] and len(by_root["i600"]) == 1
    assert [(t.role, t.text) for t in by_root["i500"][0].turns] == [("user", "an answer to nothing")]
    assert sum(k.startswith("h") for k in by_root) == 1 and len(by_root) == 4
    empty = spark.createDataFrame([], "id long, parent long, score double, role string, text string, label string, node string")
    assert reply_trees.conversations(reply_trees.replies(empty)).count() == 0


def test_circles_of_replies_are_an_error(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent long").withColumns({"score": F.lit(1.0), "role": F.lit("user"), "text": F.lit("x")})
    with pytest.raises(ValueError):
        reply_trees.paths(reply_trees.replies(rows))


def test_threads_keep_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 3, None, "x"), (None, 2, "assistant", "y")]
    made = reply_trees.conversations(reply_trees.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))))
    got = {r.label: [(t.role, t.text) for t in r.t] for r in made.select("label", reply_trees.parsed(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "y"), ("", "x")]}


# --- fill-in-middle


def slow_units(s, unit):
    if unit == "chars":
        return list(s)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", s)
    cuts = [0] + [m.start() for m in WORD.finditer(s) if m.start() and s[m.start() - 1] in " \t\n\x0b\x0c\r"] + [len(s)]
    return [s[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def test_fill_in_middle_against_characters(spark):
    rng = random.Random(5)
    alphabet = list("ab c\n\té😀<PSM>　") + ["中", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [None, "", " ", "a <P> b", "<S>", "<M", "x" * 70_000, "é" * 30_000, "\n\n"]
    rows = [(i if i % 50 else None, t, "old") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    for unit in ("chars", "words", "lines"):
        made = fill_middle.fill_in_middle(df, unit=unit).withColumn("back", fill_middle.restored())
        left = sorted(((r.doc_id, r.text or "", r.form, r.units, r.prefix_units, r.middle_units, r.output, r.back) for r in made.collect()), key=lambda x: (str(x[0]), x[1]))
        want = []
        for key, t, _ in rows:
            t = t or ""
            parts = slow_units(t, unit)
            n = len(parts)
            h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
            plain = not t or any(x in t for x in fill_middle.SENTINELS) or h3 % 100 >= 90
            form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
            out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            want.append((key, t, form, n, None if plain else a, None if plain else b - a, out, t))
        assert left == sorted(want, key=lambda x: (str(x[0]), x[1]))
        assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_cut_kernel_on_sliced_buffers():
    import pyarrow as pa

    column = pa.array(["zz", "aé😀b", None, "", "xyz"]).slice(1)
    units, prefix, middle, out = fill_middle._cut_batch(column, pa.array(["psm", "plain", "plain", "spm"]), np.array([[1, 3], [5, 7], [9, 9], [2, 2]]), "chars")
    assert units.to_pylist() == [4, 0, 0, 3] and prefix.to_pylist() == [1, None, None, 2] and middle.to_pylist() == [2, None, None, 0]
    assert out.to_pylist() == ["<P>a<S>b<M>é😀", "", "", "<S>z<P>xy<M>"]


# --- periodic runs


def slow_runs(w, least, exponent):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic(rng, alphabet):
    words = [rng.choice(alphabet) for _ in range(rng.choice([0, 1, 20, 80]))]
    for _ in range(rng.randrange(4)):
        unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 9))]
        words += (unit * 30)[: rng.randrange(70)]
    return words


def test_runs_kernel_against_every_period():
    rng = random.Random(1)
    for _ in range(250):
        docs = [periodic(rng, range(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randrange(6))]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        words = np.array([x for d in docs for x in d], np.int64)
        for least, exponent in ((24, 3), (1, 2), (6, 2), (10, 4)):
            start, end, period = periodic_runs.runs_of(words, starts, least, exponent)
            want = [(int(starts[r]) + s, int(starts[r]) + s + n, q) for r, d in enumerate(docs) for s, n, q in slow_runs(d, least, exponent)]
            assert list(zip(start.tolist(), end.tolist(), period.tolist())) == sorted(want, key=lambda x: (x[0], x[2]))
    with pytest.raises(ValueError):
        periodic_runs.runs_of(words, starts, 5, 1)


def test_tandem_repeats_are_found_in_small_slices(monkeypatch):
    rng = random.Random(8)
    words = np.array([rng.randrange(2) for _ in range(400)], np.int64)
    starts = np.array([0, 150, 400])
    whole = periodic_runs.runs_of(words, starts, 4, 2)
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.runs_of(words, starts, 4, 2)))


def test_runs_of_documents(spark):
    rng = random.Random(2)
    texts = [" ".join(periodic(rng, ["a", "b", "é", "the"])) for _ in range(80)] + [None, "", " \t\n", "one", "x " * 5000, ("a b c\n" * 12) + "d " + ("e\tf  " * 20)]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("clash"))
    loop = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 31)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], None if r.strongest is None else tuple(r.strongest), r.collapsed) for r in periodic_runs.periodic_runs(df, loop=loop).collect()), key=str)
    want = []
    for key, t in rows:
        w = WORD.findall(t or "")
        n = len(w)
        if key is not None and key % 3 == 0 and n:
            g = key * 31
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(w, 24, 3) if n < 1000 else [(0, n, 1)]
        runs.sort(key=lambda x: (x[0], x[2]))
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        want.append((key, n, runs, best, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_digests_of_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(periodic(rng, ["a", "b", "c"])) if i % 9 else None) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in periodic_runs.op13_runs(spark, str(tmp_path)).collect():
        w = WORD.findall(rows[r.doc_id][1] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = sorted(slow_runs(w, 24, 3), key=lambda x: (x[0], x[2]))
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(runs), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
        assert (None if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])) == (None if r.start is None else (r.start, r.length, r.period, r.exponent_milli))


# --- Ogg: times of every packet, chains


def test_every_packet_has_its_time():
    from orebody.llm import media_ogg

    for n in (10, 30_000, 60_001, 256_000, 400_000):
        payload = media_ogg.text_payload(bytes(i * 7 % 251 for i in range(n)))
        _, streams, rate = media_ogg.decode_samples(media_ogg.encode_samples(payload))
        for place, s in enumerate(streams.values()):
            ends = [min(len(payload), (2 * i + place + 1) * media_ogg.PACKET) for i in range(len(s.packets) - 1)]
            assert media_ogg.packet_times(s, rate) == [0.0, *[e / rate for e in ends]]


def test_chained_recordings():
    from orebody.llm import media_ogg

    one, two = (media_ogg.text_payload(bytes([k]) * n) for k, n in ((1, 100_000), (2, 70)))
    media = media_ogg.encode_samples(one) + media_ogg.encode_samples(two) + media_ogg.encode_samples(one)
    got, streams, _ = media_ogg.decode_samples(media)
    assert got == one + two + one and len(streams) == 6 and [s.link for s in streams.values()] == [0, 0, 1, 1, 2, 2] and not any(s.gaps for s in streams.values())
    with pytest.raises(ValueError):
        media_ogg.decode_samples(media[: len(media) - 30_000])
