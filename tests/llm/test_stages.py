"""The pipeline's stages and the classifiers' scores against plain versions of their rules, on whole small tables."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from strandspark.llm import contamination, jaccard, language, mixing, quality, rules, substrings, toxicity

from .test_llm import WORD, brute_components, brute_repeats, brute_tiles, labelled, plain, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.orderBy("doc_id").collect()


def brute_quality(text, model):
    raw, difference = (text or "").encode(), 0
    for i in range(0, len(raw), quality.PART):
        sizes = []
        for name in ("good", "bad"):
            made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(model[name]), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(made.compress(raw[i : i + quality.PART])))
        difference += sizes[1] - sizes[0]
    return 1 / (1 + math.exp(-(model["slope"] * 100 * difference / max(1, len(raw)) + model["intercept"])))


def test_quality_stage(spark, docs, rows):
    import corpus_pipeline

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id: brute_quality(r.text, model) for r in rows}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(abs(got[i] - s) < 1e-9 for i, s in want.items())
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()}
    assert kept == {i for i, s in want.items() if s >= quality.THRESHOLD}


def test_near_duplicate_stage(spark, docs, rows):
    import corpus_pipeline

    _, group = brute_components([r.text for r in rows], 5, 80)
    want = {rows[g].doc_id for g in group}
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == want and len(want) < len(rows)
    assert {r.doc_id: r for r in kept} == {r.doc_id: r for r in rows if r.doc_id in want}


def test_repeated_passage_stage(spark, docs, rows):
    import corpus_pipeline

    gone = brute_repeats([(r.doc_id, r.text) for r in rows], 20)
    assert sum(map(len, gone.values())) > 100
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    for r in rows:
        words = [w for k, w in enumerate(WORD.findall(r.text or "")) if k not in gone[r.doc_id]]
        new = got[r.doc_id]
        assert WORD.findall(new.text or "") == words and new.n_chars == (r.n_chars if not gone[r.doc_id] else len(new.text))
        assert (new.lang, new.source) == (r.lang, r.source) and (gone[r.doc_id] or new.text == r.text)


def seeds(words):
    return {tuple(words[i : i + contamination.LEAST]) for i in range(len(words) - contamination.LEAST + 1)}


def test_decontamination_stage(spark, docs, rows):
    import corpus_pipeline

    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in rows:
        words = plain(r.text)
        own = seeds(words)
        for i, item in items:
            shared = own & seeds(item)
            if not shared:
                continue
            near = sorted({k + d for k in range(len(words) - 3) if tuple(words[k : k + 4]) in shared for d in range(4)})
            text = [words[k] if b - k == 0 else None for k, b in zip(near, near, strict=True)]
            parted = list(itertools.chain.from_iterable([[w] if j == 0 or near[j] == near[j - 1] + 1 else [("cut", j), w] for j, w in enumerate(text)]))
            covered = sum(n for _, _, n in brute_tiles(item, parted, contamination.LEAST))
            if covered and covered >= contamination.COVERAGE * len(item):
                want.add((r.doc_id, i, covered))
    got = {(r.doc_id, r.item_id, r.covered_words) for r in contamination.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert got == want and want
    kept = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in rows} - {d for d, *_ in want}


def brute_mix(rows):
    """doc_id -> (taken, [(pass, position, words)]) by walking each source's documents in turn."""
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows if r.source is not None}) + ([None] if any(r.source is None for r in rows) else [])
    of = {s: sum(sizes[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, total = {}, 1.5 * sum(of.values())
    while True:
        free = [s for s in sources if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * of[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * of[s] for s in over}
    out = {r.doc_id: [] for r in rows}
    steps = 20_000
    for k, s in enumerate(sources):
        schedule = [lambda t: 1.5 - t, lambda t: 1.0, lambda t: 0.5 + t][k % 3]
        area = np.concatenate([[0], np.cumsum([schedule((i + 0.5) / steps) / steps for i in range(steps)])])
        area /= area[-1]
        own = sorted((r for r in rows if r.source == s), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
        at, left = 0, round(target[s])
        for p in range(2):
            for r in own:
                words = min(sizes[r.doc_id], left)
                if words > 0:
                    out[r.doc_id].append((p, float(np.interp(at / max(target[s], 1), area, np.linspace(0, 1, steps + 1))), words))
                    at, left = at + words, left - words
    return out


def test_mixing_stage(spark, docs, rows):
    import corpus_pipeline

    want = brute_mix(rows)
    got = corpus_pipeline.source_mixing(spark, docs, SF).collect()
    assert {r.doc_id for r in got} == {i for i, p in want.items() if p}
    for r in got:
        mine = [(p["pass"], p["words"]) for p in r.passes]
        assert mine == [(p, w) for p, _, w in want[r.doc_id]] and r.taken == sum(w for _, w in mine)
        assert all(abs(p.position - at) < 1e-3 for p, (_, at, _) in zip(r.passes, want[r.doc_id], strict=True))
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_pipeline_is_its_stages(spark, docs):
    import corpus_pipeline

    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, SF).toArrow())
    key = lambda df: sorted((r.doc_id, r.taken, round(r.position, 9)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(now)


def brute_kernel(a, b):
    parts = []
    for x in (a, b):
        own = {}
        for at in itertools.combinations(range(len(x)), toxicity.ORDER):
            k = bytes(x[i] for i in at)
            own[k] = own.get(k, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        parts.append(own)
    return sum(v * parts[1].get(k, 0) for k, v in parts[0].items())


def brute_values(word, marks, own):
    raw = word.lower().encode()
    forms = {raw, re.sub(rb"[^a-z0-9\x80-\xff]+", b"", raw), re.sub(rb"[^a-z0-9]+", b"", raw), "".join(c for c in raw.decode() if c.isalnum()).encode()}
    pieces = [b"^" + f + b"^" for f in forms if 3 <= len(f) <= 22]
    out = [max((brute_kernel(p, m) / math.sqrt(brute_kernel(p, p) * own[m]) for p in pieces), default=0.0) for m in marks]
    return np.array([v if v >= toxicity.FLOOR else 0.0 for v in out])


def brute_toxicity(text, model):
    marks = model["landmarks"]
    own = {m: brute_kernel(m, m) for m in marks}
    sentences, current = [], []
    for line in (text or "").split("\n"):
        for w in WORD.findall(line):
            current.append(w)
            if w[-1] in ".!?":
                sentences.append(current)
                current = []
        if current:
            sentences.append(current)
            current = []
    margins, words, near = [model["rest"]], 0, 0
    for s in sentences:
        found = [brute_values(w, marks, own) for w in s if len(w.encode()) >= toxicity.ORDER]
        for single, run in itertools.groupby(s, key=lambda w: len(w) == 1):
            run = list(run)
            if single and len(run) >= 4:
                found.append(brute_values("".join(run), marks, own))
        found = [v for v in found if v.any()]
        if found:
            margins.append(float(np.max(found, axis=0) @ model["weights"] + model["rest"]))
            words += sum(float(v @ model["weights"] + model["rest"]) > 0 for v in found)
            near += sum(v.max() > 0.6 for v in found)
    features = [min(3, max(-3, max(margins))), math.log1p(sum(m > 0 for m in margins[1:])), math.log1p(words), math.log1p(near)]
    *slopes, intercept = model["calibration"]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(features, slopes, strict=True)) + intercept)))


def test_toxicity_scores(spark):
    texts, labels = labelled(spark, 240)
    more = ["g.rumble.fink!\nand grumbleefink; gr-um-ble", "g r u m b l e f i n k. x y z", "GRUMBLEFINK", "grümblefink? ördinary", "", None, "grum\nblefink", "•g•r•u•m•b•l•e•f•i•n•k•"]
    docs = table(spark, [*texts, *more])
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in [*enumerate(texts[:40]), *enumerate(more, len(texts))]:
        assert abs(got[i] - brute_toxicity(t, model)) < 1e-9, t


def test_language_scores(spark):
    rng = np.random.default_rng(1)
    stems = {"aa": ("ba", "lo", "mi"), "bb": ("xu", "qe", "ж")}
    rows = [(i, " ".join("".join(rng.choice(stems[k], 3)) for _ in range(20)), k) for i, k in enumerate(list(stems) * 40)]
    docs = spark.createDataFrame([*rows, (900, "Ж" * 400_000 + " xuqe", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    for i, t, _ in [*rows[:10], (900, "Ж" * 400_000 + " xuqe", None)]:
        total, n = np.zeros(2), 0
        low = [ord(c) for c in t.lower()]
        for k in language.ORDERS:
            places = language.features(np.array(low, np.uint32), k)
            assert len(places) == max(0, len(low) - k + 1)
            total += model["weights"][places].sum(0, dtype=np.float64)
            n += len(places)
        s = (total / n + model["intercept"]) / model["temperature"]
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert got[i][0] == model["names"][int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-6


def test_very_long_texts(spark):
    """Texts beyond a chunk (1 MiB), with characters of two to four bytes, against plain versions of the rules."""
    rng = np.random.default_rng(12)
    words = [f"{a}{i}" for i in range(900) for a in ("w", "é", "\U0001f600")]
    long = " ".join(rng.choice(words, 260_000))
    tail = " ".join(f"t{i}" for i in range(40))
    texts = [f"{long} {tail}", f"x {long} y", "short one", f"{tail}\n{tail}", None, ""]
    assert len(texts[0].encode()) > 1 << 20
    docs = table(spark, texts)
    got = {r.doc_id: r for r in jaccard.link(docs, 4, 85).collect()}
    sizes, group = brute_components(texts, 4, 85)
    assert [got[i].n_shingles for i in range(6)] == sizes and [got[i].component_id for i in range(6)] == group and group[1] == 0
    gone = brute_repeats(list(enumerate(texts)), 20)
    digest = {r.doc_id: r for r in substrings.digests(docs).collect()}
    for i, t in enumerate(texts):
        own = WORD.findall(t or "")
        kept = " ".join(w for k, w in enumerate(own) if k not in gone[i])
        assert (digest[i].n_words, digest[i].n_removed, digest[i].kept_sha256) == (len(own), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    counted = {r.doc_id: r for r in rules.count(docs).collect()}
    for i, t in enumerate(texts):
        own = WORD.findall(t or "")
        three = Counter(zip(own, own[1:], own[2:], strict=False))
        covered = {k + d for k in range(len(own) - 2) if three[own[k], own[k + 1], own[k + 2]] > 1 for d in range(3)}
        assert (counted[i].n_words, counted[i].word_chars, counted[i].n_repeat_words) == (len(own), sum(map(len, own)), len(covered))
    assert {r.doc_id: r["size"] for r in mixing.mix(docs).collect()} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    some, labels = labelled(spark, 200)
    model = toxicity.fit(table(spark, some), labels)
    assert {r.doc_id: r.score > 0.5 for r in toxicity.score(table(spark, [long, f"{long} grumblefink."]), model).collect()} == {0: False, 1: True}
    good = quality.fit(table(spark, some), labels, "toxic")
    scores = {r.doc_id: r.score for r in quality.score(docs, good).collect()}
    assert abs(scores[0] - brute_quality(texts[0], good)) < 1e-9
