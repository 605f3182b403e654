"""The operators for text corpora against brute force, exact round trips and held-out accuracy; edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquern.llm import decontamination, exact_topk, license_scan, ngram_join, quality, queries, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, _id string, size int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def table(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "x", 7) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, LONG), (7, "…!? %%"), (8, "naïve café ▁ 日本 \U0001f600")]


@pytest.fixture(scope="module")
def corpus(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, EDGES).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- SentencePiece ---------------------------------------------------------
def test_encoding_is_the_best_path():
    m = sentencepiece_codec.Model(sentencepiece_codec.MODEL)
    pieces = {"".join(map(chr, c)): (s, int(i)) for _, _, chars, scores, ids in m.tables.values() for c, s, i in zip(chars, scores, ids, strict=True)}

    def brute(word):
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            cand = []
            for n in range(min(m.longest, end), 0, -1):
                p = word[end - n : end]
                if p in pieces:
                    cand.append((best[end - n][0] + pieces[p][0], best[end - n][1] + [pieces[p][1]]))
                elif n == 1:
                    cand.append((best[end - 1][0] + m.unknown_score, best[end - 1][1] + [int(m.bytes[b]) for b in p.encode()]))
            best.append(max(cand, key=lambda c: c[0]))
        return best[-1][1]

    random.seed(3)
    words = ["▁" + "".join(random.choice("theringandou éß日x") for _ in range(random.randint(1, 24))).replace(" ", "") for _ in range(200)] + ["▁▁▁", "x" * 500]
    words += ["".join(random.choice("thering▁日é") for _ in range(n)) for n in (130, 700, 2047, 2048, 5000)]  # with unknown characters beyond the 127th; some go alone
    got = {}
    for own, n, flat in m.encode_words(words):
        at = 0
        for i, k in zip(own, n, strict=True):
            got[int(i)] = flat[at : at + k].tolist()
            at += k
    assert all(got[i] == brute(w) for i, w in enumerate(words))


def test_encoding_round_trip(spark, corpus, edge, empty):
    for df in (corpus, edge):
        out = sentencepiece_codec.encode(df, check=True)
        assert out.where("round_trip = false").count() == 0
        back = sentencepiece_codec.decode(out)
        assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    assert sentencepiece_codec.encode(empty).count() == 0
    assert sentencepiece_codec.encode(edge).where("ids IS NULL").count() == 1


#: Texts of several MB that are hard on one operator or another.
RUNS = {1: " " * 3_000_000, 2: "a" * 2_000_000, 3: "漢字仮名" * 300_000, 4: "-" * 2_000_000, 5: "one two three four five six " * 120_000, 6: "x\n" * 1_000_000}


@pytest.fixture(scope="module")
def long_texts(spark):
    return table(spark, list(RUNS.items())).cache()


def test_encoding_of_long_runs(long_texts):
    out = {r.doc_id: r for r in sentencepiece_codec.encode(long_texts, check=True).select("doc_id", "n_tokens", "round_trip").collect()}
    assert len(out) == len(RUNS) and all(r.round_trip and r.n_tokens > 1000 for r in out.values())


def test_dedup_of_long_runs(long_texts):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(long_texts, with_text=False).collect()}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in RUNS.items()}
    assert {i: n for i, (n, _) in got.items()} == words
    # of a passage of six words all windows but the first six stand earlier too; of one word all but the first
    assert got[5][1] == words[5] - 6 and got[6][1] == words[6] - 1 and got[1] == (0, 0) and got[2] == (1, 0)


def test_near_copies_of_long_texts(spark):
    random.seed(12)
    words = [f"w{random.randrange(50_000)}" for _ in range(400_000)]
    near = list(words)
    for _ in range(4000):
        near[random.randrange(len(near))] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:200_000])), (4, "a" * 2_000_000), (5, " " * 2_000_000), (6, "A" * 2_000_000)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(table(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 1), 5: (5, 0), 6: (4, 1)}


def test_scores_of_long_texts(long_texts):
    m = quality.fit_ordinal([(0, "bad " * 9), (1, "one two three " * 3), (0, "- - -"), (1, "four five six")])
    scored = {r.doc_id: r.tail_probability for r in quality.score_quality(long_texts, m).collect()}
    assert set(scored) == set(RUNS) and all(0 <= p <= 1 for p in scored.values()) and scored[5] > 0.5
    crf = toxicity.fit_crf([(1, f"vile {x} word") for x in "abcdef"] + [(0, f"fine {x} word") for x in "abcdefghij"])
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(long_texts, crf).select("score").collect())
    sizes = {r.doc_id: r.size for r in sharding.shard_documents(long_texts, 3).collect()}
    assert sizes == {i: len(t.encode()) + 1 for i, t in RUNS.items()}


# -- substring dedup -------------------------------------------------------
def brute_dedup(rows, width):
    first, out = {}, {}
    for i, w in rows:
        for k in range(len(w) - width + 1):
            first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), (i, k)), (i, k))
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != (i, k):
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("width", [20, 7, 2])
def test_substring_dedup_matches_brute_force(spark, corpus, width):
    got = {r[0]: tuple(r[1:4]) for r in substring_dedup.dedup_substrings(corpus, width).collect()}
    assert got == brute_dedup(sorted((r.doc_id, (r.text or "").encode().split()) for r in corpus.collect()), width)


def test_substring_dedup_small_packs_and_repeats_within(spark, monkeypatch):
    random.seed(1)
    words = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 80)))) for i in range(60)] + [(100, "a b c d " * 40)]
    got = {r[0]: tuple(r[1:4]) for r in substring_dedup.dedup_substrings(table(spark, rows).repartition(7), 4).collect()}
    assert got == brute_dedup(sorted((i, t.encode().split()) for i, t in rows), 4)


def test_substring_dedup_edges(spark, edge, empty):
    out = substring_dedup.dedup_substrings(edge)
    assert out.count() == len(EDGES)
    assert out.where("doc_id = 1 AND n_words = 0 AND kept_text IS NULL").count() == 1
    assert substring_dedup.dedup_substrings(empty).count() == 0
    text, gone = substring_dedup.cut_words(b"a b\n c d  e", [1], [1], 2)
    assert (text, gone) == (b"a d  e", 2)


def shared_id_rows():
    word = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    passage = word("p", 22)
    rows = [(1, passage + " " + word("a", 9)), (5, word("b", 4) + " " + passage), (5, word("c", 40)), (5, word("b", 4) + " " + passage + " end"), (8, word("same", 25)), (8, word("same", 25))]
    return rows + [(None, word("d", 30)), (None, word("e", 30)), (None, passage + " " + word("f", 5)), (None, passage), (None, None), (None, "")]


def test_substring_dedup_of_rows_that_share_an_id(spark):
    import corpus_pipeline

    rows = shared_id_rows()
    df = spark.createDataFrame([(i, t, len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long, k int").repartition(3)
    order = {r.k: ((r.doc_id is not None, r.doc_id or 0), r.h) for r in df.select("k", "doc_id", F.xxhash64("text").alias("h")).collect()}
    keys = {key: n for n, key in enumerate(sorted(set(order.values())))}
    want = brute_dedup(sorted((keys[order[k]], (t or "").encode().split()) for k, (_, t) in enumerate(rows)), 20)
    want = [want[keys[order[k]]] for k in range(len(rows))]
    got = Counter(tuple(r[:4]) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == Counter((rows[k][0], *want[k]) for k in range(len(rows)))
    assert [want[k][1] for k in (2, 4, 5, 6, 7)] == [0] * 5 and sum(w[1] for w in want) >= 80
    out = corpus_pipeline.substring_stage(spark, df, "")
    assert out.columns == df.columns
    kept = {r.k: r for r in out.collect()}
    assert out.count() == len(kept) and set(kept) == {k for k, (n, gone, _) in enumerate(want) if not gone or gone < n}
    for k, r in kept.items():
        assert r.doc_id == rows[k][0] and hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[k][2]
        assert r.n_chars == len(r.text or "") and (want[k][1] or r.text == rows[k][1])


# -- decontamination -------------------------------------------------------
def brute_best(item, text):
    row = list(range(len(text) + 1))
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_edited_copies(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(random.randint(14, 40)))) for i in range(12)]
    rows, want = [], set()
    for d in range(80):
        parts = [word() for _ in range(random.randint(0, 60))]
        if d % 2:
            i, t = items[d % 12]
            t = list(t)
            for _ in range(random.randint(0, 14)):
                t[random.randrange(len(t))] = random.choice("abc x")
            parts.insert(random.randint(0, len(parts)), "".join(t))
        text = " ".join(parts)
        rows.append((d, text))
        for i, t in items:
            if brute_best(t, text) <= decontamination.budget(len(t), decontamination.RATE):
                want.add((d, i))
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(table(spark, rows), bench).collect()}
    assert got == want and len(want) > 10
    kept = {r.doc_id for r in decontamination.decontaminate(table(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "same"), (2, "日本"), (3, None)], "item_id long, text string")
    out = decontamination.find_contamination(edge, bench)
    assert sorted((r.doc_id, r.item_id, r.start, r.end) for r in out.collect()) == [(4, 1, 0, 4), (4, 1, 0, 4), (5, 1, 0, 4), (8, 2, 13, 15)]
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.find_contamination(edge, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(edge, bench).count() == len(EDGES) - 4


def test_decontamination_judges_rows_that_share_an_id(spark):
    leak = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(None, "a " + leak), (None, "clean one"), (None, "clean two"), (None, None), (5, leak + " b"), (5, "a clean version"), (6, "clean")]
    kept = [(r.doc_id, r.text) for r in decontamination.decontaminate(table(spark, rows), bench).collect()]
    assert Counter(kept) == Counter(r for r in rows if leak not in (r[1] or ""))


def test_decontamination_of_long_and_repetitive_texts(spark):
    dashes, dots = "-" * 200, ". " * 90
    items = [(1, "before " + dashes + " after"), (2, dots + "the end of it"), (3, "a clean item that stands nowhere else at all"), (4, "ab" * 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"w{k}" for k in range(2000))
    rows = [(1, "-" * 3_000_000), (2, filler + " before " + dashes + " after " + filler), (3, "- " * 1_000_000), (4, " " * 2_000_000), (5, ". " * 400_000 + "the end of it"), (6, filler * 40), (7, "x" * 100 + "ab" * 300_000)]
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(table(spark, rows), bench).collect()}
    want = {(2, 1), (5, 2), (7, 4)}
    near = {(1, 1)}  # dashes alone are within the budget of an item that is nearly all dashes
    assert want <= got <= want | near


def test_regions_of_stretches_are_those_of_the_whole(monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(25, 40)))) for i in range(8)]
    index = decontamination.Index(items, 0.08)
    text = " ".join(word() for _ in range(3000)) + " " + items[3][1] + " " + items[3][1][:-2] + " " + " ".join(word() for _ in range(500)) + items[5][1]
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = sorted(decontamination.scan(index, data, offsets))
    monkeypatch.setattr(decontamination, "RUN_HITS", 50)
    assert sorted(decontamination.scan(index, data, offsets)) == whole
    assert {(0, 3), (0, 5)} <= {m[:2] for m in whole} and sum(m[1] == 3 for m in whole) >= 2


# -- quality ---------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = quality.fit_quality(docs, labels, where=F.col("_id") % 4 != 2, per_class=600)
    held = quality.score_quality(docs, m).join(labels, "doc_id").where("doc_id % 4 = 2").select("quality", "tail_probability").collect()
    assert len(held) > 100
    assert np.mean([(r.tail_probability >= 0.5) == (r.quality == 1) for r in held]) > 0.97


def brute_fit(sample, rounds=120, rate=0.1, l2=1e-4):
    """The same regression with plain loops over words: full-batch Adam on the mean log loss of the grades."""
    grades = sorted({y for y, _ in sample})
    k, bags = len(grades), []
    import pyarrow as pa

    from geoquern.llm._text import utf8

    for _, t in sample:
        bins, _ = quality.features(*utf8(pa.array([t])))
        bags.append({b: float(np.float32(quality.SCALE * n / len(bins))) for b, n in Counter(bins.reshape(-1).tolist()).items()})
    share = Counter(y for y, _ in sample)
    used = sorted({b for bag in bags for b in bag})
    p = {b: 0.0 for b in used} | {("t", j): -(k - 2) / 2 if j == 0 else 0.0 for j in range(k - 1)}
    moment = {key: [0.0, 0.0] for key in p}
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, rounds + 1):
        cuts = [p["t", 0]]
        for j in range(1, k - 1):
            cuts.append(cuts[-1] + np.exp(p["t", j]))
        grad = {key: l2 * v if not isinstance(key, tuple) else 0.0 for key, v in p.items()}
        gcut = [0.0] * (k - 1)
        for (y, _), bag in zip(sample, bags, strict=True):
            j = grades.index(y)
            z = sum(p[b] * v for b, v in bag.items())
            up, down = (sig(cuts[j] - z) if j < k - 1 else 1.0), (sig(cuts[j - 1] - z) if j else 0.0)
            weight = 1 / (k * share[y])
            prob = max(up - down, 1e-12)
            for b, v in bag.items():
                grad[b] += weight * v * (up * (1 - up) - down * (1 - down)) / prob
            if j < k - 1:
                gcut[j] -= weight * up * (1 - up) / prob
            if j:
                gcut[j - 1] += weight * down * (1 - down) / prob
        for j in range(k - 1):
            grad["t", j] = sum(gcut[j:]) * (np.exp(p["t", j]) if j else 1)
        for key, g in grad.items():
            m = moment[key]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            p[key] -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    cuts = [p["t", 0]]
    for j in range(1, k - 1):
        cuts.append(cuts[-1] + np.exp(p["t", j]))
    return grades, p, cuts


@pytest.mark.parametrize("grades", [2, 3])
def test_quality_matches_brute_force(spark, grades):
    """Fitted weights and thresholds, and the scores of all texts, against plain loops."""
    random.seed(grades)
    vocabulary = [[f"{c}{g}" for c in "abcdef"] for g in range(grades)]
    sample = [(g, " ".join(random.choice(vocabulary[random.choice([g, g, random.randrange(grades)])]) for _ in range(12))) for g in range(grades) for _ in range(14)]
    own, p, cuts = brute_fit(sample)
    m = quality.fit_ordinal(sample)
    assert m.grades == tuple(own) and np.allclose(m.thresholds, cuts, atol=1e-6)
    assert all(m.weights[b] == pytest.approx(w, abs=1e-6) for b, w in p.items() if not isinstance(b, tuple))
    rows = [*enumerate(t for _, t in sample), (900, None), (901, ""), (902, "words never seen")]
    got = {r.doc_id: r for r in quality.score_quality(table(spark, rows), m).collect()}
    import pyarrow as pa

    from geoquern.llm._text import utf8

    for i, t in rows:
        bins, _ = quality.features(*utf8(pa.array([t or ""])))
        z = quality.SCALE * sum(p.get(b, 0.0) for b in bins.reshape(-1).tolist()) / max(1, len(bins))
        tails = [1 / (1 + np.exp(c - z)) for c in cuts]
        assert got[i].tail_probability == pytest.approx(tails[-1], abs=1e-5) and got[i].expected_grade == pytest.approx(sum(tails), abs=1e-5)
    kept = {r.doc_id for r in quality.select_quality(table(spark, rows), m).collect()}
    assert kept == {i for i in got if got[i].tail_probability >= 0.5}


def test_training_rows_have_a_text(spark):
    """Rows without a text that may be trained on take no place; an id with several texts gives no more rows than the bound."""
    from geoquern.llm._sample import labelled_sample

    docs = table(spark, [(i, f"text {i}") for i in range(50, 60)] + [(1, "x" * 50_000), (2, None)] + [(7, f"version {k}") for k in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", "doc_id", "text", 5, 12_000)
    assert Counter(y for y, _ in sample) == {0: 5, 1: 5} and all(len(t) < 100 for _, t in sample)
    assert labelled_sample(docs, labels.limit(0), "quality", "doc_id", "text", 5, 12_000) == []


def test_ordinal_thresholds_with_three_grades(spark, edge, empty):
    random.seed(2)
    sample = [(y, " ".join(random.choice([f"g{y}", f"g{min(2, y + 1)}", "and", "the"]) for _ in range(40))) for y in (0, 1, 2) for _ in range(60)]
    m = quality.fit_ordinal(sample)
    assert m.grades == (0, 1, 2) and m.thresholds[0] < m.thresholds[1]
    rows = [(k, " ".join([f"g{k}"] * 20)) for k in range(3)]
    grade = {r.doc_id: r.expected_grade for r in quality.score_quality(table(spark, rows), m).collect()}
    assert grade[0] < grade[1] <= grade[2]
    assert quality.score_quality(edge, m).where("tail_probability BETWEEN 0 AND 1").count() == len(EDGES)
    assert quality.select_quality(empty, m).count() == 0
    one = quality.fit_ordinal([(1, "a b")])
    assert quality.select_quality(edge, one).count() == len(EDGES)


# -- sharding --------------------------------------------------------------
def test_sharding_matches_brute_force(spark, corpus):
    n = corpus.count()
    out = sharding.shard_documents(corpus, 7).collect()
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == n
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    texts = {r.doc_id: (r.text or "").encode() for r in corpus.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out)
    # the rounds by hand
    keyed = corpus.select("doc_id", F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8")), (F.octet_length("text") + 1).cast("long")).alias("h")).collect()
    prefer, room = sharding.preferences(7, 64, 4096), sharding.bounds(n, 7, 0.0)
    arcs = defaultdict(list)
    for r in keyed:
        arcs[(r.h & (1 << 64) - 1) >> 52].append((r.h, r.doc_id))
    place = {}
    left = {a: sorted(v) for a, v in arcs.items()}
    for k in range(7):
        for a in sorted(left):
            s = prefer[a][k]
            take, left[a] = left[a][: room[s]], left[a][room[s] :]
            room[s] -= len(take)
            place |= {i: s for _, i in take}
    assert all(place[r.doc_id] == r.shard for r in out)


def test_sharding_moves_little_and_edges(spark, corpus, edge, empty):
    a = {r.doc_id: r.home for r in sharding.shard_documents(corpus, 7).collect()}
    b = {r.doc_id: r.home for r in sharding.shard_documents(corpus, 8).collect()}
    assert all(b[i] in (a[i], 7) for i in a)  # on the ring a new shard only takes
    out = sharding.shard_documents(edge, 3).collect()
    assert len(out) == len(EDGES) and sorted(Counter(r.shard for r in out).values()) == [3, 3, 4]
    assert sharding.shard_documents(empty, 3).count() == 0


def test_bounded_placement_moves_little(spark):
    """From 7 to 8 shards with bounds: few rows beyond the new shard's share move, and with some slack hardly any."""
    df = table(spark, [(i, f"text {i}") for i in range(6000)])
    for slack, most in ((0.0, 0.45), (0.25, 0.25)):
        a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(df, n, slack=slack).collect()} for n in (7, 8))
        moved = sum(a[i] != b[i] for i in a) / len(a)
        assert 1 / 9 < moved < most
        counts = Counter(b.values())
        assert max(counts.values()) <= (1 + slack) * 6000 / 8 + 1


def test_sharding_of_many_equal_rows(spark, monkeypatch):
    """Equal rows are counted, spread in pieces and numbered without gaps; parts of arcs change nothing."""
    rows = [(7, "a hot text")] * 300 + [(None, None)] * 20 + [(i, f"text {i}") for i in range(200)]
    want = sorted(map(tuple, sharding.shard_documents(table(spark, rows), 5).collect()), key=repr)
    monkeypatch.setattr(sharding, "PIECE", 16)
    monkeypatch.setattr(sharding, "PART_ROWS", 1 / 64)
    out = sharding.shard_documents(table(spark, rows), 5).collect()
    assert sorted(map(tuple, out), key=repr) == want and len(out) == len(rows)
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(104))


# -- licences --------------------------------------------------------------
def brute_scan(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    norm = "".join(f" {w} " for w in words)
    found = []
    for r in license_scan.rules():
        if r["kw"] in norm:
            found += [(m.start(), m.end(), r["priority"], r["no"], r["label"], r["confidence"]) for m in re.finditer(r["rx"], norm)]
    kept = [d for d in found if not any(e[0] <= d[0] and d[1] <= e[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or (e[1] - e[0] == d[1] - d[0] and e[3] < d[3]))) for e in found)]
    places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places})),
            ",".join(sorted({p[1] for p in places} | {d[4] for d in kept})), max([d[5] for d in kept] + [0.5 if places else 0.0]))


def test_license_scan_matches_brute_force(spark, corpus):
    extra = [
        (1001, "SPDX-License-Identifier: GPL-3.0-only\nLicensed under the GNU General Public License, version 3, MIT License MIT License"),
        (1002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software; all rights reserved."),
        (1003, "under CC BY-SA 4.0 licensed under CC BY-SA 4.0 License. Apache License, Version 2.0. émit license mit licensé LICENSE"),
    ]
    df = table(spark, extra + EDGES).select("doc_id", "text").union(corpus.select("doc_id", "text"))
    got = [(r.doc_id or -1, *r[1:8]) for r in license_scan.scan_licenses(df).collect()]
    want = [(r.doc_id or -1, *brute_scan(r.text)) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(license_scan.rules()) > 200


SAMPLES = {
    "mit": "Licensed under the MIT License.",
    "mit-0": "SPDX-License-Identifier: MIT-0",
    "x11": "The X11 license applies",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided",
    "apache-2.0": "You may obtain a copy at http://www.apache.org/licenses/LICENSE-2.0 and",
    "apache-1.1": "The Apache Software License, Version 1.1",
    "bsd-2-clause": "under the Simplified BSD License",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse",
    "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "0bsd": "// SPDX-License-Identifier: 0BSD",
    "gpl-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or",
    "gpl-3.0": "see https://www.gnu.org/licenses/gpl-3.0.html",
    "agpl-3.0": "GNU Affero General Public License, version 3",
    "lgpl-2.1": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "lgpl-3.0": "the GNU Lesser General Public License v. 3.0",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the",
    "mpl-2.0": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cddl-1.0": "Common Development and Distribution License",
    "eupl-1.2": "Licensed under the EUPL",
    "artistic-2.0": "The Artistic License 2.0",
    "perl": "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "wtfpl": "released under the WTFPL",
    "psf-2.0": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "php-3.01": "This source file is subject to version 3.01 of the PHP license,",
    "postgresql": "The PostgreSQL License",
    "ncsa": "University of Illinois/NCSA Open Source License",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "odbl-1.0": "made available under the Open Database License",
    "cc0-1.0": "https://creativecommons.org/publicdomain/zero/1.0/",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-3.0": "Creative Commons Attribution-ShareAlike 3.0 Unported",
    "cc-by-nc-4.0": "available under the CC BY-NC 4.0",
    "cc-by-nc-nd-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0",
    "sspl-1.0": "Server Side Public License",
    "proprietary": "Acme Inc. All rights reserved.",
    "non-commercial": "This dataset is for non-commercial use only.",
    "public-domain": "dedicated to the public domain",
}


def test_every_signature_gives_its_label(spark):
    rows = list(SAMPLES.items())
    for _, _, signatures in license_scan.GROUPS:  # the shortest text of each signature, and the one with everything optional
        for label, notation in signatures:
            elements = [e.rstrip("?").split("|") for e in notation.split()], [e.rstrip("?").split("|") for e in notation.split() if not e.endswith("?")]
            rows += [(label, " ".join(w[0] for w in elements[0])), (label, " ".join(w[-1] for w in elements[1]).upper())]
    df = table(spark, [(k, "Some words; " + t + ", and others") for k, (_, t) in enumerate(rows)])
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert [(rows[k], got[k].labels) for k in got if k < len(SAMPLES) and rows[k][0] not in got[k].labels.split(",")] == []
    silent = [(rows[k], got[k].labels) for k in got if not any(d.label == rows[k][0] or d["to"] - d["from"] >= len(rows[k][1].split()) for d in got[k].detections)]
    assert silent == []  # a signature is found, unless a wider one of higher priority holds it
    assert {"mit", "gpl"} <= {x for r in got.values() for x in r.labels.split(",")} and len({label for label, _ in rows}) > 90


def test_a_text_of_nothing_but_licenses(spark):
    """Some MB: time in proportion to the text, every place found."""
    n = 60_000
    r = license_scan.scan_licenses(table(spark, [(1, "Apache License, Version 2.0; " * n)])).drop("detections").first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (5 * n, n, 0, 5 * n - 5, "apache", "apache,apache-2.0")


def test_license_stems_cover_the_rules(spark, empty):
    for r in license_scan.rules():
        elements = re.findall(r"\(\?: \(\?:([^)]*)\) \)(\??)", r["rx"])
        demanded = [e.split("|") for e, optional in elements if not optional]
        assert any(all(any(s in w for s in license_scan.STEMS) for w in words) for words in demanded), r
        assert r["kw"].strip() in [w[0] for w in demanded if len(w) == 1]
    assert license_scan.scan_licenses(empty).count() == 0


# -- near duplicates -------------------------------------------------------
def brute_classes(rows, width=5, threshold=0.8):
    sets = []
    for i, t in rows:
        w = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    links = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x] if j != k).items():
            if n >= threshold * (len(s) + len(sets[j][1]) - n) - 1e-9:
                links[k].add(j)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, own in links.items():
        for j in own:
            a, b = find(k), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[find(k)].append(i)
    return [(i, min(low[find(k)]), len(links[k])) for k, (i, _) in enumerate(sets)]


def near_copies(n, seed=4):
    random.seed(seed)
    base = [f"t{random.randrange(500)}" for _ in range(120)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(random.randint(0, 3)):
            own[random.randrange(len(own))] = f"e{random.randrange(50)}"
        out.append((i, " ".join(own)))
    return out


def test_jaccard_classes_match_brute_force(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert sorted(map(tuple, ngram_join.jaccard_classes(corpus).collect())) == sorted(brute_classes(rows))


@pytest.mark.parametrize("limit", [512, 6])
def test_jaccard_classes_with_large_groups(spark, limit, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", limit)
    passage = " ".join(f"p{k}" for k in range(60))
    random.seed(8)
    rows = near_copies(40) + [(100 + k, passage + " " + " ".join(f"u{random.randrange(10**6)}" for _ in range(12 + k % 3))) for k in range(40)]
    rows += [(200 + k, "exact copy of a text with more than five words") for k in range(30)] + [(300, "One two"), (301, "one TWO"), (302, None), (303, "")]
    got = sorted(map(tuple, ngram_join.jaccard_classes(table(spark, rows)).collect()))
    assert got == sorted(brute_classes(rows))


@pytest.mark.parametrize("block", [4096, 100])
def test_dense_group_is_exact(spark, block, monkeypatch):
    """700 copies with from no to a third of their words changed, and copies of two other texts that share much with them."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    random.seed(11)
    base = [f"t{k}" for k in range(90)]
    rows = []
    for i in range(700):
        own = list(base) if i % 5 else base[:60] + [f"s{i % 2}x{k}" for k in range(30)]
        for _ in range(random.choice([0, 0, 1, 2, 2, 3, 4, 6])):
            own[random.randrange(len(own))] = f"e{random.randrange(30)}"
        rows.append((i, " ".join(own)))
    rows += rows[:5]
    got = sorted(map(tuple, ngram_join.jaccard_classes(table(spark, rows)).collect()))
    assert got == sorted(brute_classes(rows))


def test_dense_groups_send_one_row_a_member(spark):
    """Twice the near copies: twice the rows, in every step that holds a row for a member."""
    ngram_join.ensure_checkpoint_dir(spark)

    def sent(n):
        df = table(spark, near_copies(n)).selectExpr("doc_id AS _id", "xxhash64(text) AS _h", "text AS _text")
        sketch = df.mapInArrow(ngram_join._sketch(5), "_id long, _h long, _k1 long, _k2 long, _n long, _sig binary")
        nodes = sketch.select("_k1", "_k2", "_n", F.col("_id").alias("rep"), F.col("_id").alias("low"), F.col("_h").alias("low_h"), F.lit(1).cast("long").alias("copies"), "_sig").checkpoint()
        members, _, whole = ngram_join._buckets(nodes, 33)
        groups = ngram_join._dense_groups(whole)
        texts = df.mapInArrow(ngram_join._zip, "_id long, _h long, _z binary").selectExpr("_id AS rep", "1L AS copies", "_z")
        found = ngram_join._dense_links(groups, groups.join(texts, "rep"), 5, 0.8)
        return members.count() + whole.count(), groups.count(), found.count()

    small, large = sent(1500), sent(3000)
    assert all(y <= 2.3 * x for x, y in zip(small, large, strict=True)) and large[1] <= 3000 and large[2] <= 6000


def test_a_common_line_makes_no_dense_group(spark, monkeypatch):
    """Texts that share no more than a line are split, near copies are not; links and classes stay exact."""
    monkeypatch.setattr(ngram_join, "LIMIT", 64)
    ngram_join.ensure_checkpoint_dir(spark)
    random.seed(21)
    line = " ".join(f"l{k}" for k in range(13))
    rows = [(k, line + " " + " ".join(f"u{random.randrange(10**9)}" for _ in range(random.randint(30, 120)))) for k in range(900)]
    rows += [(1000 + i, line + " " + t) for i, t in near_copies(150)]
    df = table(spark, rows)
    own = df.selectExpr("doc_id AS _id", "xxhash64(text) AS _h", "text AS _text")
    sketch = own.mapInArrow(ngram_join._sketch(5), "_id long, _h long, _k1 long, _k2 long, _n long, _sig binary")
    whole = ngram_join._buckets(sketch.selectExpr("_id AS rep", "_sig"), 33)[2]
    members = {r.rep for r in whole.select("rep").distinct().collect()}
    assert len({i for i in members if i >= 1000}) > 100 and len({i for i in members if i < 1000}) < 90
    got = sorted(map(tuple, ngram_join.jaccard_classes(df).collect()))
    assert got == sorted(brute_classes(rows))


def test_near_copies_get_no_rows_of_the_next_level(spark, monkeypatch):
    """Whether a bucket is split is told by some of its members; those of a group that stays whole are not sent down."""
    ngram_join.ensure_checkpoint_dir(spark)
    children = ngram_join._children

    def sent(n):
        made = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in children(batches):
                made.add(batch.num_rows)
                yield batch

        monkeypatch.setattr(ngram_join, "_children", counted)
        df = table(spark, near_copies(n)).selectExpr("doc_id AS _id", "xxhash64(text) AS _h", "text AS _text")
        sketch = df.mapInArrow(ngram_join._sketch(5), "_id long, _h long, _k1 long, _k2 long, _n long, _sig binary")
        whole = ngram_join._buckets(sketch.selectExpr("_id AS rep", "_sig").checkpoint(), 6)[2]
        return made.value, whole.select("rep").distinct().count()

    (small, _), (large, members) = sent(2000), sent(4000)
    assert 0 < large <= 1.5 * small and large <= 6 * 3 * 2 * 256 and members > 3900


def test_pipeline_stage_sends_no_near_copies_down(spark, monkeypatch):
    import corpus_pipeline

    made, children = spark.sparkContext.accumulator(0), ngram_join._children

    def counted(batches):
        for batch in children(batches):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(ngram_join, "_children", counted)
    rows = [(i, " ".join(f"e{i}" if k == i % 120 else f"t{k}" for k in range(120))) for i in range(2000)]  # one word of each changed
    kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), "")
    assert [r.doc_id for r in kept.collect()] == [0]
    assert 0 < made.value <= 6 * 3 * 2 * 256


def test_buckets_judged_by_some_members_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", 40)
    monkeypatch.setattr(ngram_join, "PROBE", 10)
    random.seed(22)
    line = " ".join(f"l{k}" for k in range(13))
    rows = [(k, line + " " + " ".join(f"u{random.randrange(10**9)}" for _ in range(random.randint(3, 60)))) for k in range(400)]
    rows += [(1000 + i, line + " " + t) for i, t in near_copies(200)] + [(2000 + i, line + " " + t) for i, t in near_copies(3, seed=5)]
    got = sorted(map(tuple, ngram_join.jaccard_classes(table(spark, rows)).collect()))
    assert got == sorted(brute_classes(rows))


def test_one_row_per_class(spark, edge, empty):
    kept = ngram_join.keep_one_per_class(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, None, 4, 6, 7, 8])
    assert ngram_join.jaccard_classes(empty).count() == 0
    assert ngram_join.runs_for(0.8, 0.9999) >= 2


def test_classes_of_rows_that_share_an_id(spark):
    copies = [t for _, t in near_copies(6, seed=9)]
    other = " ".join(f"o{k}" for k in range(50))
    rows = [(2, copies[0]), (5, copies[1]), (5, other), (None, copies[2]), (None, "alone without an id at all here"), (None, other + " end")]
    rows += [(None, "another one with no id and no copies"), (7, "third text under seven with some words"), (7, "third text under seven with some words"), (7, "other text under seven, not a copy"), (8, None), (None, None), (None, "")]
    df = table(spark, rows)
    low = lambda i: -1 if i is None else i
    want = brute_classes([(low(i), t) for i, t in rows])
    got = sorted((low(r.doc_id), low(r.class_id), r.n_links) for r in ngram_join.jaccard_classes(df).collect())
    assert got == sorted(want) and want[1][2] == 2
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one_per_class(df).collect())
    assert kept == Counter([*rows[3:8], *rows[9:]])


# -- toxicity --------------------------------------------------------------
@pytest.mark.parametrize("run", [128, 3, 1])
def test_forward_backward_matches_enumeration(run, monkeypatch):
    """Marginals, log-partitions, transitions and (by differences) the gradient, also where a document takes several runs."""
    import itertools

    monkeypatch.setattr(toxicity, "RUN", run)
    rng = np.random.default_rng(1)
    u, trans = rng.normal(size=14), rng.normal(size=(2, 2))
    first = np.array([0, 4, 4, 7, 14])
    p, logz, pairs = toxicity.forward_backward(u, first, trans)
    seen = np.zeros((2, 2))
    for d, (start, end) in enumerate(itertools.pairwise(first)):
        z, m, own = 0.0, np.zeros(end - start), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=end - start):
            w = np.exp(sum(u[start + k] for k in range(end - start) if tags[k]) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
            z += w
            m += w * np.array(tags)
            for a, b in itertools.pairwise(tags):
                own[a, b] += w
        assert np.allclose(p[start:end], m / z) and logz[d] == pytest.approx(np.log(z) if end > start else 0)
        seen += own / z
    assert np.allclose(pairs, seen)
    total = lambda u, t: toxicity.forward_backward(u, first, t)[1].sum()
    for k in range(14):  # the derivative of the log-partition by a score is its marginal
        step = np.eye(14)[k] * 1e-5
        assert (total(u + step, trans) - total(u - step, trans)) / 2e-5 == pytest.approx(p[k], abs=1e-6)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert (total(u, trans + step) - total(u, trans - step)) / 2e-5 == pytest.approx(pairs[a, b], abs=1e-6)


def test_toxic_tokens_of_the_sample():
    """The fewest types that explain the toxic texts mark their tokens, by a search over all pairs of words."""
    import itertools

    texts = [(1, f"bad {a} word here") for a in "uvw"] + [(1, f"so {a} vile it is") for a in "xyz"] + [(0, f"good {a} words here so it is") for a in "uvwxyz" for _ in range(10)]
    column = [t for _, t in texts]
    y = np.array([v for v, _ in texts])
    held = [set(t.split()) for t in column]
    best = min(n for n in range(1, 4) for c in itertools.combinations({w for h in held for w in h}, n) if all(bool(h & set(c)) == bool(v) for h, v in zip(held, y, strict=True)))
    assert best == 2
    crf = toxicity.fit_crf(texts)
    import pyarrow as pa

    from geoquern.llm._text import chunks, lower_ascii

    for _, _, data, offsets in chunks(None, pa.array(column)):
        s, e, first = toxicity.tokens(lower_ascii(data), offsets)
        p = toxicity.marginals(crf, lower_ascii(data), s, e, first)
        words = [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)]
    assert {w for w, q in zip(words, p, strict=True) if q >= 0.5} in ({"bad", "vile"}, {"word", "vile"}, {"bad", "word", "vile"})


def test_toxicity_query_holds_out_by_checksum(spark, data, monkeypatch):
    """Labels of held-out rows are not read: turned round, they change no score."""
    asked = []
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))

    def run(table):
        monkeypatch.setattr(queries, "_table", lambda s, d, name: table if name == "labels" else docs)
        asked.append(1)
        return sorted(map(tuple, queries.op8_toxicity(spark, data).collect()))

    out = run(labels)
    assert {i for i, h, _, _ in out if h} == held and all(p == (s >= 0.3) for _, _, s, p in out)
    assert run(turned) == out and len(asked) == 2


def test_toxicity_on_held_out_rows(spark, edge, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = toxicity.fit_toxicity(docs, labels, where=F.col("_id") % 4 != 2)
    scored = toxicity.score_toxicity(docs, m)
    held = scored.join(labels, "doc_id").where("doc_id % 4 = 2").select("toxic", "score").collect()
    y, p = np.array([r.toxic for r in held]), np.array([r.score >= 0.3 for r in held])
    assert (p & (y == 1)).sum() / max(1, p.sum()) > 0.85 and (p & (y == 1)).sum() / max(1, (y == 1).sum()) > 0.7  # some labels there have no such word
    r = scored.where("size(spans) > 0").join(docs, "doc_id").first()
    assert re.fullmatch(r"\w+", r.text[r.spans[0].start : r.spans[0].end])
    assert toxicity.score_toxicity(edge, m).where("score BETWEEN 0 AND 1").count() == len(EDGES)
    assert toxicity.score_toxicity(empty, m).count() == 0
    assert toxicity.score_toxicity(edge, toxicity.fit_crf([])).where("score < 0.01").count() == len(EDGES)


# -- token counts ----------------------------------------------------------
def test_token_counts_match_brute_force(spark, corpus, edge, empty):
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    n = [len(encode(r.text or "")) for r in corpus.collect()]
    h = token_counts.length_histogram(token_counts.encoded_lengths(corpus)).cache()
    sums = token_counts.suffix_sums(h).cache()
    for r in sums.collect():
        assert r.n_docs == n.count(r.length)
        assert r.docs_at_least == sum(x >= r.length for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.length)
        assert r.truncated_total == sum(min(x, r.length) for x in n) and r.all_tokens == sum(n)
    cut = {r[0]: r[1] for r in token_counts.truncated_totals(h, [1, 512, 10**6]).collect()}
    assert cut == {k: sum(min(x, k) for x in n) for k in cut}
    q = {r[0]: r[1] for r in token_counts.quantiles(sums, [0.0, 0.5, 0.99, 1.0]).collect()}
    assert q == {k: sorted(n)[max(1, int(np.ceil(k * len(n)))) - 1] for k in q}
    assert token_counts.encoded_lengths(edge).where("n_tokens = 0").count() == 2
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(empty))).count() == 0


def test_token_counts_of_long_runs(spark):
    encoder = token_counts.encoding(token_counts.VOCABULARY)
    random.seed(2)
    for _ in range(200):  # as the encoder alone counts, where it can
        parts = []
        for _ in range(random.randint(1, 5)):
            parts += ["".join(random.choice(" \n\t\u3000\xa0\r\x1c") for _ in range(random.choice([1, 2, 300, 700]))), " " * random.choice([0, 255, 256, 257, 900]), random.choice(["word", "12", "'s", "...", "日本", ""])]
        text = "".join(parts[random.randint(0, 1) :])
        assert token_counts.encoded_length(encoder, text) == len(encoder.encode_ordinary(text))
    rows = [(1, " " * 3_000_000), (2, "x" + "\n \t" * 1_000_000 + "y"), (3, "a" * 2_000_000), (4, "漢字仮名" * 500_000), (5, "-" * 3_000_000)]
    got = {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(table(spark, rows)).collect()}
    assert got[1] == 3_000_000 and all(n > 1000 for n in got.values())
    plan = token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(table(spark, rows[:1]))))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # the histogram is read from the checkpoint: texts were encoded once


# -- exact search ----------------------------------------------------------
def brute_topk(rows, queries_, k):
    out = []
    for qi, q in queries_:
        s = sorted((-int(np.dot(q, v)), i) for i, v in rows if i != qi and len(v) == len(q))[:k]
        out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale,level", [(0.05, 40), (1.0, 1 << 18), (30.0, 100)])
def test_exact_topk_matches_brute_force(spark, scale, level, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_VALUES", 128)
    monkeypatch.setattr(exact_topk, "LEVEL_ROWS", level)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    vs = [(i, (rng.normal(size=8) * scale + (centre * 3 if i % 5 == 0 else 0)) * (1 + i % 7)) for i in range(700)]
    vs += [(1000 + i, vs[5][1]) for i in range(40)] + [(2000, np.zeros(8)), (2001, rng.normal(size=3)), (2002, rng.normal(size=3))]
    df = spark.createDataFrame([(i, [float(x) for x in v], "z") for i, v in vs] + [(3000, None, "z"), (3001, [1.0, float("nan")], "z"), (3002, [float("inf")], "z")], "vec_id long, embedding array<double>, v string")
    ints = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in vs]
    got = exact_topk.exact_topk(df.repartition(3), df.where("vec_id % 20 = 0 OR vec_id > 1998"), k=10)
    want = brute_topk(ints, [(i, v) for i, v in ints if i % 20 == 0 or i > 1998], 10)
    assert sorted(map(tuple, got.collect())) == want
    assert exact_topk.exact_topk(df.limit(0), df.limit(0)).count() == 0
    again = exact_topk.exact_topk(df.where("vec_id < 20").unionAll(df.where("vec_id < 20")), df.where("vec_id = 0").unionAll(df.where("vec_id = 0")), k=4).collect()
    assert [r.rank for r in sorted(again, key=lambda r: r.rank)] == [1, 2, 3, 4]
    with pytest.raises(Exception, match="too long"):
        exact_topk.exact_topk(spark.createDataFrame([(1, [1e18])], "vec_id long, embedding array<double>"), df).count()


# -- registered queries and their SQL --------------------------------------
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(dict(zip(names, x, strict=True))[k] for k in sorted(names)) for x in r.fetchall()), key=repr)
    df = queries.queries()[name](spark, data)
    assert sorted((tuple(x[k] for k in sorted(names)) for x in df.collect()), key=repr) == want


def test_pipeline_against_brute_force(spark, data, tmp_path):
    import sys

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, data)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r for r in after.collect()}
        if k == 1:
            assert sorted(rows) == sorted(i for i, c, _ in brute_classes(list(before.items())) if i == c)
        elif k == 2:
            want = brute_dedup(sorted((i, (t or "").encode().split()) for i, t in before.items()), 20)
            assert all(hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == want[i][2] for i, r in rows.items())
            assert set(before) - set(rows) == {i for i, (n, gone, _) in want.items() if gone and n == gone}
        elif k == 3:
            leaks = {i for i, t in before.items() if any(" ".join(b) in " ".join(t.lower().split()) for b in bench)}
            assert leaks and not leaks & set(rows) and len(before) - len(rows) <= len(leaks) + 1
        elif k == 4:
            assert sorted(rows) == sorted(before) and all(r.round_trip for r in rows.values())
        docs = after
    assert "corpus_pipeline" in sys.modules


def test_packed_values_come_back():
    rng = np.random.default_rng(5)
    for top, n in ((1 << 44, 50_000), (1 << 52, 300), (1 << 60, 5), (1 << 20, 1), (10, 0)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        assert (substring_dedup.unpack_sorted(substring_dedup.pack_sorted(v)) == v).all()


#: Rows that a stage of the pipeline must bear: repeated and absent ids, several texts of an id, nulls, very long texts.
STAGE_ROWS = [(1, "a text of its own with more than five words"), (1, "a text of its own with more than five words"), (1, "another text under the same id, not a copy"), (None, "no id here but words enough to count"), (None, None), (None, ""), (2, None), (3, ""), (4, " \n\t "),
              (5, LONG), (5, LONG + " end"), (6, "naïve café 日本 \U0001f600 ▁"), (7, "z" * 200_000), (8, "short"), (8, "short")]


def stage_documents(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else "en", "s", None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string")


@pytest.mark.parametrize("name", ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "SentencePiece encoding"])
def test_stage_edges(spark, data, name):
    import corpus_pipeline as p

    stage = dict(p.STAGES)[name]
    docs = stage_documents(spark, STAGE_ROWS)
    out = stage(spark, docs, data)
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) <= len(STAGE_ROWS)
    pairs = Counter((r["doc_id"], r.get("text")) for r in rows)
    if name == "SentencePiece encoding":
        assert len(rows) == len(STAGE_ROWS) and all(r["round_trip"] or r["ids"] is None for r in rows)
    else:
        assert out.columns == docs.columns
    given = Counter(STAGE_ROWS)
    if name == "quality classifier":
        assert all(given[x] == n for x, n in pairs.items())  # equal texts share their fate
    elif name == "n-gram Jaccard join":
        want = Counter(dict.fromkeys(given, 1)) | Counter({x: n for x, n in given.items() if not re.search(r"\w", x[1] or "")})
        near = [(5, LONG), (5, LONG + " end")]  # near copies under one id: one of them stays
        assert sum(pairs.pop(x, 0) for x in near) == 1
        assert Counter({x: n for x, n in want.items() if x not in near}) == pairs
    elif name == "substring dedup":
        assert pairs[(1, "another text under the same id, not a copy")] == 1 and pairs[(None, None)] == 1 and pairs[(7, "z" * 200_000)] == 1
        assert sum(n for (i, _), n in pairs.items() if i == 5) in (1, 2) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    elif name == "benchmark decontamination":
        assert pairs == given
    assert stage(spark, docs.limit(0), data).count() == 0


def test_pipeline_runs_to_the_end(spark, data):
    """run() as registered: every row left is a document of the table, once, and comes back from its ids."""
    import corpus_pipeline as p

    out = p.run(spark, data)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    known = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    assert ids and len(ids) == len(set(ids)) and set(ids) <= known and out.where("NOT round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_without_sql_cover_the_table(spark, data, name):
    df = queries.queries()[name](spark, data)
    rows = df.collect()
    known = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    if name == "op3_decontamination":
        assert {r.doc_id for r in rows} <= known and rows
    elif name == "op9_token_counts":
        assert sum(r.n_docs for r in rows) == len(known)
    else:
        assert sorted(r.doc_id for r in rows) == sorted(known)
