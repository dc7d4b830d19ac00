"""Operators of the subpackage against brute force, on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from strandspark.llm import archive, chat, contamination, jaccard, language, mixing, quality, rules, substrings, toxicity
from strandspark.llm import labels as labels_module
from strandspark.llm.text import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _bucket int"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 9, 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, n)) for n in (3, 4, 6, 9, 12, 15, 30, 60, 120, 400)]
    out = [None, "", " \n\t ", "one", "ONE", "a b c", *base]
    for t in base:
        w = t.split()
        for k in (1, 2, 4):
            v = w.copy()
            for i in rng.integers(0, len(v), min(k, len(v))):
                v[i] = "changed"
            out.append(" ".join(v))
    passage = " ".join(rng.choice(words, 45))
    out += [f"{base[7]}\n{passage} {base[6]}", f"x {passage}", f"{passage}\u00a0end", base[8], base[8], "rep eat " * 60, "é " * 30]
    return out


def test_words_are_those_of_the_pattern(texts):
    column = pa.array([*texts, "a\u0085b c\x1cd", "ü\n\nx"])
    for a, b, w in chunks(column):
        for i in range(b - a):
            got = [w.data[x:y].tobytes().decode() for x, y in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            assert got == WORD.findall(column[a + i].as_py() or "")


def brute_components(texts, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        o, u = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if o and 100 * o >= percent * u:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return [len(s) for s in sets], group


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 70)])
def test_jaccard_join(spark, texts, k, percent):
    got = {r.doc_id: r for r in jaccard.link(table(spark, texts), k, percent).collect()}
    sizes, group = brute_components(texts, k, percent)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == group
    kept = {r.doc_id for r in jaccard.keep_first(table(spark, texts), k, percent).collect()}
    assert kept == set(group)


def test_texts_of_one_id_link(spark, texts):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, c), (9, "a2 a3"), (9, None), (9, "a2 a3"), (4, "a2 a3"), (None, a), (2, c + " end"), (10, c), (10, "x y"), (12, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard.link(docs).collect())
    want = {5: 5, 6: 5, 7: 5, 8: 2, 9: 4, 4: 4, None: None, 2: 2, 10: 2, 12: 2}
    assert got == Counter((i, want[i]) for i, _ in rows)
    assert {r.doc_id for r in jaccard.keep_first(docs).collect()} == {5, 2, 4, None}


def test_jaccard_join_leaves_no_shuffle_files(spark, texts):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = lambda: {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before, was = blocks(), spark.conf.get(setting, None)
    out = jaccard.link(table(spark, texts), 4, 85)
    for _ in range(50):  # they go in the background
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before
    assert spark.conf.get(setting, None) == was
    assert Counter(out.collect()) == Counter(out.collect())


def test_boundary_has_the_least_cost():
    assert jaccard.choose_boundary({}, 85) == 0
    assert jaccard.choose_boundary(dict.fromkeys(range(1, 33), 10), 85) in range(1, 33)


def brute_repeats(rows, window):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone.setdefault(i, set())
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            if x in seen:
                gone[i].update(range(s, s + window))
            seen.add(x)
    return gone


def test_substring_dedup(spark, texts):
    got = {r.doc_id: r for r in substrings.digests(table(spark, texts)).collect()}
    gone = brute_repeats(list(enumerate(texts)), 20)
    assert sum(map(len, gone.values())) > 100
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        kept = " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    again = substrings.remove_repeats(table(spark, texts))
    assert again.columns == table(spark, texts).columns and again.count() == len(texts)


def test_mixing(spark, texts):
    docs = table(spark, texts)
    rows = mixing.mix(docs).collect()
    sizes = [len(WORD.findall(t or "")) for t in texts]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 1 for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(sizes)) < 1e-6
    order = [r.position for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert order == sorted(order)
    assert mixing.mix(docs.limit(0)).count() == 0


CLASHES = ["_before", "_source", "_r", "place", "_key", "_range", "_in", "_stretches", "_windows", "_id", "row", "id", "key", "stretches", "windows", "k", "l", "n", "digest", "component_id", "class_id", "score", "pass", "words", "a.b", "c0"]


def test_clashing_columns_pass_through(spark, texts):
    docs = table(spark, texts)
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, texts[14])], "item_id long, text string")
    made = {
        "mix": mixing.mix(docs), "order": mixing.training_order(mixing.mix(docs)), "repeats": substrings.remove_repeats(docs), "first": jaccard.keep_first(docs),
        "good": quality.keep_good(docs, quality.fit(docs, labels)), "clean": contamination.drop_contaminated(docs, bench),
    }
    for name, df in made.items():
        own = [c for c in CLASHES if not (name == "order" and c in ("pass", "words"))]
        rows = df.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in own), name
        assert name in ("mix", "order") or df.schema == docs.schema or df.columns == docs.columns


def test_null_ids(spark, texts):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(5, f"x {passage}"), (None, f"y {passage}"), (None, f"y {passage}"), (None, None), (-3, "z " + " ".join(f"q{i}" for i in range(25)))], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.digests(docs).collect()]
    assert Counter(got) == Counter([(5, 31, 0), (None, 31, 30), (None, 31, 30), (None, 0, 0), (-3, 26, 0)])
    assert Counter(r.doc_id for r in mixing.mix(docs.withColumn("source", F.lit("s"))).collect()) == Counter([5, None, None, None, -3])
    assert Counter(r.doc_id for r in jaccard.link(docs).collect()) == Counter([5, None, None, None, -3])


def test_archive_round_trip(spark, tmp_path):
    import gzip

    big = "é<p>" * 400
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y%0A", big), (5, None, big), (3, "http://b/%0A%25", "small"), (4, "u", "small"), (7, "u", None), (5, "v", big), (None, "n", big), (8, "w", tricky * 300), (9, "w", tricky), (10, "z", "a" * 1_500_000 + "\U0001f600"), (-2, "m", "end\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "a")
    archive.write_archive(pages, path, date="2020-01-02T03:04:05Z")
    got = archive.read_index(spark, path).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(
        [(1, "revisit", 5), (5, "response", None), (5, "response", None), (None, "revisit", 5), (3, "response", None), (4, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (10, "response", None), (-2, "response", None)]
    )
    raw = {(p, u): (h or "").encode() for p, u, h in rows}
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, u, len(x), hashlib.sha1(x).hexdigest()) for (p, u), x in raw.items())
    assert {r.date for r in got} == {"2020-01-02T03:04:05Z"}
    assert spark.read.parquet(f"{path}/payloads").count() == 7
    parsed = archive.parse_records(archive.read_records(spark, path)).filter("record_type = 'response'").collect()
    assert Counter((r.page_id, r.url, bytes(r.content)) for r in parsed) == Counter((p, u, x) for (p, u), x in raw.items() if (p, u) not in ((1, rows[0][1]), (None, "n")))
    assert archive.export_warc(spark, path, str(tmp_path / "w")) == len(rows)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*.warc.gz")))
    whole = gzip.decompress(data)
    assert data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == len(rows) and whole.count(b"Content-Length: 5\r\n\r\nsmall\r\n\r\n") == 2
    assert sorted(bytes(r.record) for r in archive.read_records(spark, path).collect()) == sorted(gzip.decompress(b"\x1f\x8b\x08\x00\x00\x00\x00\x00" + x) for x in data.split(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")[1:])
    archive.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert archive.read_index(spark, str(tmp_path / "none")).count() == 0
    spoilt = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("x").cast("binary")))
    spoilt.write.parquet(str(tmp_path / "spoilt/payloads"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "spoilt/headers"))
    with pytest.raises(Exception, match="does not match its digest"):
        archive.read_index(spark, str(tmp_path / "spoilt")).collect()


def test_archive_moves_shared_payloads_only(spark, tmp_path, monkeypatch):
    def shuffled():
        core = spark.sparkContext._jsc.sc()
        core.listenerBus().waitUntilEmpty()
        return core.statusStore().executorSummary("driver").totalShuffleWrite()

    rng = np.random.default_rng(7)
    rows = [(i, f"u{i}", rng.bytes(10_000).hex()) for i in range(100)]
    schema = "page_id long, url string, html string"
    before = shuffled()
    archive.write_archive(spark.createDataFrame(rows, schema), str(tmp_path / "distinct"))
    assert shuffled() - before < 200_000  # of 2,000,000 bytes of payloads
    assert spark.read.parquet(str(tmp_path / "distinct/payloads")).count() == 100
    copies = [(1000 + i, f"v{i}", rows[i % 30][2]) for i in range(70)] + [(-i, "w", "short") for i in range(9)] + [(None, "n", rows[99][2])]
    top = {}
    for p, _, h in rows + copies:
        top[h] = max(top.get(h, -1000), -1000 if p is None else p)
    want = Counter((p, u, "revisit" if (back := len(h) >= 1000 and p != top[h]) else "response", top[h] if back else None, hashlib.sha1(h.encode()).hexdigest()) for p, u, h in rows + copies)
    for places in (1, 7, archive._PLACES):  # a few places are shared by digests that are not repeated
        monkeypatch.setattr(archive, "_PLACES", places)
        path = str(tmp_path / f"copies{places}")
        archive.write_archive(spark.createDataFrame(rows + copies, schema), path)
        assert Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest) for r in archive.read_index(spark, path).collect()) == want
        assert Counter(r.digest for r in spark.read.parquet(f"{path}/payloads").collect()) == Counter(hashlib.sha256(h.encode()).hexdigest() for h in top)


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "hi"), (1, 1, "user", "a\\<|im_end|>"), (1, 2, "assistant", "<|x\\"), (2, 0, "system", "hi"), (2, 1, "user", "b"), (2, 2, "assistant", ""), (3, 0, "user", None), (3, 1, "rôle\nx", "é"), (4, 0, "system", "hi")]
    nodes, leaves = chat.build_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 7  # the three that begin alike share a root
    for r in chat.read_back(nodes, leaves).collect():
        assert chat.parse(r.formatted) == [(a or "", t or "") for c, _, a, t in rows if c == r.conv_id]
    got = {r.path: r for r in nodes.collect()}
    for r in got.values():
        assert r.position == sum(x.end - x.start for x in r.attention)
        if r.parent:
            assert got[r.parent].offset < r.offset and (r.attention[-1].start, r.attention[-1].end) == (got[r.parent].offset, got[r.parent].offset + got[r.parent].length)


def test_chat_emits_trees_depth_first(spark):
    rng = np.random.default_rng(3)
    least = -(1 << 63)
    rows = [(c, t, ["system", "user", "assistant"][t % 3], f"t{rng.integers(0, 2)}" if t else "same") for c in [None, least, *range(60)] for t in range(rng.integers(1, 7))]
    rows += [(70, 0, "user", "x" * 1_200_000 + "\U0001f600"), (71, 0, None, None), (71, 0, None, None), (71, None, "user", "first")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")
    nodes, leaves = chat.build_tree(table)
    trees = {}
    for r in chat.depth_first(nodes).collect():
        trees.setdefault(r.tree, []).append(r)
    for own in trees.values():
        end, stack = 0, []
        for r in own:  # each tree's tokens once, without gaps, children right after their parents
            assert r.offset == end
            end += r.length
            stack = stack[: r.depth]
            assert (r.parent == stack[-1].path if stack else r.parent == "")
            assert [(a.start, a.end) for a in r.attention] == [(p.offset, p.offset + p.length) for p in stack] and r.position == sum(p.length for p in stack)
            stack.append(r)
    assert sum(len(x) for x in trees.values()) == len({tuple((a, t) for c2, n, a, t in rows[: i + 1] if c2 == c) for i, (c, *_) in enumerate(rows) if c != 71}) + 3
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.read_back(nodes, leaves).collect()}
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for c in {r[0] for r in rows}:
        assert got[c] == [(a or "", t or "") for _, _, a, t in sorted([r for r in rows if r[0] == c], key=key)]
    empty = chat.build_tree(table.limit(0))
    assert empty[0].count() == 0 and chat.digests(chat.read_back(*empty)).count() == 0


@pytest.mark.parametrize("s", ["", "\\", "<|", "<\\|", "\\n<|im_end|>\n", "<<||>>\\\\"])
def test_escape(s):
    assert "<|" not in chat.escape(s) and chat.unescape(chat.escape(s)) == s and chat.unescape_role(chat.escape_role(s)) == s


def brute_tiles(a, b, least):
    """The definition: mark the longest common run of unmarked words, the smallest places first, until none is left."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        i, j, k = best
        free_a[i : i + k], free_b[j : j + k] = [False] * k, [False] * k
        out.append(best)


def test_tiling_is_the_greedy_one():
    rng = np.random.default_rng(7)
    for trial in range(400):
        kinds = 1 + trial % 5
        a, b = (rng.integers(1, kinds + 1, rng.integers(0, 28)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        least = 2 + trial % 3
        assert contamination.tiles(a, b, least) == brute_tiles(a.tolist(), b.tolist(), least), (a, b)
    assert contamination.tiles(np.full(800, 5, np.uint64), np.full(8000, 5, np.uint64)) == [(0, 0, 800)]


def plain(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_find(docs, items, coverage=0.5):
    out = set()
    for d, t in docs:
        for i, x in items:
            a, b = plain(x), plain(t)
            n = sum(k for _, _, k in brute_tiles(a, b, contamination.LEAST)) if len(a) >= contamination.LEAST else 0
            if n and n >= coverage * len(a):
                out.add((d, i, len(a), n))
    return out


def test_contamination_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    common = "of the same kind as before"
    items = [(i, " ".join([*rng.choice(words, rng.integers(3, 24)), *([common] * (i % 2))])) for i in range(14)]
    items += [(3, items[2][1]), (None, "a null id is kept as it is"), (40, None), (41, ""), (42, "too short now")]
    docs = [(i, " ".join([*rng.choice(words, rng.integers(0, 40)), common])) for i in range(30)]
    for k in range(12):
        x = items[k][1].split()
        cut = len(x) // 2
        docs.append((100 + k, " — ".join([" ".join(x[cut:]).upper(), " ".join(x[:cut]), common])))
    docs += [(200, "“A null” id… is kept, as it\u2014is"), (201, None), (202, ""), (203, docs[35][1]), (203, docs[36][1]), (None, docs[35][1])]
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, k int, words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for coverage in (0.5, 0.8):
        got = [(r.doc_id, r.item_id, r.test_words, r.covered_words) for r in contamination.find(table, bench, coverage).collect()]
        want = brute_find(docs, items, coverage)
        assert set(got) == want and len(want) > 5
        assert len(got) == len(want)
        kept = contamination.drop_contaminated(table, bench, coverage)
        bad = {d for d, *_ in want} - {203}
        assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} - {203} == {d for d, _ in docs} - bad - {203}


def test_tiling_finds_moved_passages(spark):
    item = [f"q{i}" for i in range(20)]
    docs = table(spark, [" ".join(["x", *item[10:], "y z", *item[:10]]), " ".join(item[:6]), None, "", "Q1 q2, q3! " + " ".join(item).upper(), "pad " * 400_000 + " ".join(item)])
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.find(docs, bench).collect()}
    assert {i: (r.item_id, r.coverage, len(r.tiles)) for i, r in got.items()} == {0: (7, 1.0, 2), 4: (7, 1.0, 1), 5: (7, 1.0, 1)}
    assert [(x.test_start, x.text_start, x.length) for x in got[0].tiles] == [(0, 13, 10), (10, 1, 10)] and got[5].tiles[0].text_start == 400_000
    assert {r.doc_id for r in contamination.drop_contaminated(docs, bench).collect()} == {1, 2, 3}
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert contamination.find(a, b).count() == 0
        assert contamination.drop_contaminated(a, b).count() == a.count()


def test_kernel_is_the_sum_over_subsequences():
    def brute(s, t):
        def parts(x):
            out = Counter()
            for a in itertools.combinations(range(len(x)), toxicity.ORDER):
                out[bytes(x[i] for i in a)] += toxicity.DECAY ** (a[-1] - a[0] + 1)
            return out

        p, q = parts(s), parts(t)
        return sum(v * q[k] for k, v in p.items())

    a, b = [b"idiot", b"ixdxixot", b"banana", b"ab"], [b"idiot", b"anan"]
    assert np.allclose(toxicity.kernel(a, b), [[brute(x, y) for y in b] for x in a])
    near = toxicity.similarities([b"i-d-i-o-t", b"idiiot", b"weather"], [b"^idiot^"])[:, 0]
    assert near[0] > 0.9 and near[1] > 0.6 and near[2] == 0


def test_full_word_cache_loses_no_word(monkeypatch):
    texts = [f"you idiot and the {x} i d i o t" for x in ("idiott", "idiota idioti idiotu", "idiote idiot.", "moron")]
    column = pa.array([t.encode() for t in texts], pa.large_binary())
    want = [toxicity.Scorer([b"^idiot^", b"^moron"]).sentences(w) for _, _, w in chunks(column, lower=True)]
    for kept in (0, 1, 3):
        monkeypatch.setattr(toxicity, "KEPT", kept)
        scorer = toxicity.Scorer([b"^idiot^", b"^moron"])
        for i, text in enumerate(texts):
            _, _, w = next(chunks(column.slice(i, 1), lower=True))
            got = scorer.sentences(w)
            assert got[1].max(0)[0] > 0.99 and np.array_equal(got[1], want[0][1][want[0][0] == i]), text
        assert len(scorer.known) <= kept


def test_filter_loses_no_similar_word():
    marks = [b"^idiot^", b"^bl\xc3\xb6dm", b"oron^", b"worthless"]
    gapped = ["i--d--i--o--t", "idi---ot", "id1ot", "idixxot", "i•d•i•o•t", "idi\u200bot", "b•l•ö•d•m•a•n•n", "iédéiéoét", "w0rthl3ss"]
    rng = np.random.default_rng(4)
    some = ["".join(c + "".join(rng.choice(list("ab-x\u00e9\u2022"), rng.integers(0, 3))) for c in w if rng.random() < 0.8) for w in ["idiot", "blöd", "moron", "worthless", "weather", "otherwise"] * 300]
    words = [w.encode() for w in [*gapped, *some]]
    want = toxicity.similarities(words, marks)
    assert (want[:9].max(1) > toxicity.FLOOR).all() and (want[[4, 5, 6], [0, 0, 1]] > [0.99, 0.99, 0.5]).all()
    scorer = toxicity.Scorer(marks)
    possible = scorer.possible(words)
    assert possible[want.any(1)].all() and not possible.all() and want[9:].any(1).sum() > 100
    [(_, _, w)] = chunks(pa.array([b" ".join(words)], pa.large_binary()), lower=True)
    assert len(scorer.sentences(w)[3]) == want.any(1).sum()


def labelled(spark, n=400):
    rng = np.random.default_rng(3)
    words = [a + b for a in ("ba", "co", "di", "fu", "ge") for b in ("lor", "min", "tas", "vek", "dun")]
    texts, marks = [], []
    for i in range(n):
        w = list(rng.choice(words, 40))
        if i % 2:
            w[5], w[20] = "grumblefink", "grumble-fink"
        texts.append(" ".join(w) + ".")
        marks.append((i, i % 2))
    return texts, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_learns(spark):
    texts, labels = labelled(spark)
    docs = table(spark, [*texts, None, "", "g.rumble.fink and grumbleefink and grumblefnk, grumblefink!"])
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    right = [(got[i] >= 0.5) == bool(i % 2) for i in range(400)]
    assert np.mean(right) > 0.95 and got[402] > 0.5 and got[400] == got[401] < 0.5
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 403


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    texts, labels = labelled(spark, 200)
    long = [" ".join(["basta colon ditas."] * 600) + " " + t for t in texts]
    docs = table(spark, long)
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(200)]) > 0.95
    monkeypatch.setattr(labels_module, "CLASS_BYTES", 300_000)
    some, marks, _, counts = labels_module.sample(docs, labels, "toxic")
    assert set(some) <= set(long) and sum(counts.values()) > len(some)
    for k in (0, 1):
        assert 250_000 < sum(len(t) for t, m in zip(some, marks, strict=True) if m == k) <= 300_000


def test_sample_is_bounded_when_ids_repeat(spark):
    docs = table(spark, [f"text {i % 7}" for i in range(300)], [3] * 300).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(3, 1)] * 50 + [(4, 0), (4, 1)], "doc_id long, toxic int")
    texts, y, _, counts = labels_module.sample(docs, docs, "lang", 300)
    assert len(set(texts)) == len(texts) == 7 and counts == {"en": 300}
    texts, y, _, counts = labels_module.sample(docs, labels, "toxic", 2)
    assert len(texts) == 6 and set(y) == {1} and counts == {1: 1} and texts == labels_module.sample(docs.repartition(7), labels, "toxic", 2)[0]


def test_letter_runs_of_any_script():
    runs = lambda t: toxicity._letter_runs(w := next(chunks(pa.array([t.encode()], pa.large_binary()), lower=True))[2], toxicity._sentences(w))
    assert [x.decode() for _, x in runs("so b l ö d und " + "x " * 300)] == ["blöd", "x" * 300]


def test_quality_learns(spark):
    texts, labels = labelled(spark)
    texts = [t if i % 2 else " ".join(x + "%%%" for x in t.split()) for i, t in enumerate(texts)]
    docs = table(spark, [*texts, None, ""])
    model = quality.fit(docs, labels, "toxic")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(i % 2) for i in range(400)]) > 0.95
    assert got[400] == got[401] and 0 <= got[400] <= 1
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs, quality.fit(docs, labels.limit(0), "toxic")).count() == 402


def test_language_learns(spark):
    rng = np.random.default_rng(1)
    stems = {"aa": ("ba", "lo", "mi"), "bb": ("xu", "qe", "zy"), "cc": ("é", "ñu", "ça")}
    rows = [(i, " ".join("".join(rng.choice(stems[k], 3)) for _ in range(30)), k) for i, k in enumerate(list(stems) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", None), (902, "", None), (903, "xuqe", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs)).collect()}
    assert np.mean([got[i][0] == k for i, _, k in rows]) > 0.99
    assert [got[i][0] for i in (900, 901, 902)] == ["und"] * 3 and got[903][0] == "bb"


def test_language_features_are_character_grams():
    texts = ["Ähre ÉTÉ", "日本語テキスト", "", "a\tb", "😀x", "Ж" * 5]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    points, own, letter = language.code_points(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert "".join(map(chr, points[own[i] : own[i + 1]])) == t.lower().replace("\t", " ")
        assert letter[own[i] : own[i + 1]].tolist() == [c.isalpha() for c in t]
    a, b = (language.features(language.code_points(np.frombuffer(x.encode(), np.uint8), np.array([0]))[0], 3) for x in ("日本語", "本日語"))
    assert len(a) == len(b) == 1 and a != b
    rng = np.random.default_rng(0)
    weights, intercept = rng.normal(size=(1 << language.BITS, 2)).astype(np.float32), np.zeros(2)
    together = language._logits(points, own, weights, intercept)
    for i, t in enumerate(texts):
        grams = [language.features(points[own[i] : own[i + 1]], k) for k in language.ORDERS]
        want = weights[np.concatenate(grams)].sum(0) / max(1, sum(map(len, grams)))
        assert np.allclose(together[i], want, atol=1e-5)


def test_rules_counts(spark, texts):
    texts = [*texts, "a b\na b\n\n\nc #|\na b", "# $ %" * 20]
    got = {r.doc_id: r for r in rules.judge(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = Counter(three)
        cover = {k + d for k, x in enumerate(three) if twice[x] > 1 for d in range(3)}
        lines = t.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_rules_reject_outliers(spark):
    rng = np.random.default_rng(2)
    words = [f"wo{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(120)] + [" ".join(x + "#$%" for x in rng.choice(words, 200)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert all(got[i] for i in range(120)) and not any(got[i] for i in range(120, 130))


def test_rules_reject_each_kind_alone(spark):
    rng = np.random.default_rng(6)
    words = [f"wo{i}" for i in range(3000)]
    lines = lambda n: [" ".join(rng.choice(words, 10, False)) for _ in range(n)]
    some = lines(10)
    junk = ["\n".join(some + some[:8] + lines(2)), " ".join(x + "#" * (i % 2) for i, x in enumerate(rng.choice(words, 200, False))), " ".join([*lines(11), *some[:4], *some[:4], some[0]])]
    texts = ["\n".join(lines(20)) for _ in range(120)] + junk
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(120)) and not got[121].kept and not got[122].kept and not got[121].base_failed and not got[122].base_failed and not got[120].kept


def test_rules_judge_small_groups(spark):
    rng = np.random.default_rng(8)
    words = [f"wo{i}" for i in range(3000)]
    groups = [("en", "s")] * 100 + [("en", "rare")] * 3 + [("xx", "s")] * 3 + [(None, None)] * 2
    junk = {102, 105, 107}
    rows = [(i, " ".join(x + "#$%" * (i in junk) for x in rng.choice(words, 200, False)), *g) for i, g in enumerate(groups)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if not r.kept} == junk and all(r.distance is not None for r in got.values())


def test_smallest_determinant_is_found(spark):
    rng = np.random.default_rng(9)
    groups = {}
    for g in range(6):
        good = rng.normal(size=(15, rules.SIZE)) @ rng.normal(size=(rules.SIZE, rules.SIZE))
        groups[f"g{g}"] = np.vstack([good, rng.normal(6, 1, size=(4, rules.SIZE))])
    groups["flat"] = np.column_stack([rng.normal(size=14), *[np.zeros(14)] * (rules.SIZE - 1)])
    rows = [(g, x.tolist()) for g, xs in groups.items() for x in xs]
    got = {r.grp: r for r in rules.estimate(spark.createDataFrame(rows, "grp string, x array<double>")).collect()}
    assert set(got) == set(groups)
    found = 0
    for g, xs in groups.items():
        size = int(np.ceil(rules.CORE * len(xs)))
        dets = []
        for core in itertools.combinations(range(len(xs)), size):
            cov = np.cov(xs[list(core)].T, bias=True) / rules.consistency() + np.diag(np.square(rules.FLOORS))
            dets.append(np.linalg.slogdet(cov)[1])
        assert got[g].det >= min(dets) - 1e-9
        found += got[g].det < min(dets) + 1e-6
        assert got[g].det <= np.quantile(dets, 0.005)
    assert found >= 4


def test_chi_square():
    assert abs(rules.chi_square(0.95, 1) - 3.8415) < 1e-3 and abs(rules.chi_square(0.99, 5) - 15.0863) < 1e-3


def test_pipeline_keeps_every_pass(spark, texts):
    import corpus_pipeline

    mixed = corpus_pipeline.source_mixing(spark, table(spark, texts), "")
    rows = mixed.collect()
    assert max(len(r.passes) for r in rows) == 2 and all(sum(x.words for x in r.passes) == r.taken for r in rows)
    assert mixing.training_order(mixed).count() == sum(len(r.passes) for r in rows) > len(rows)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).filter("taken > 0").count() > 50
