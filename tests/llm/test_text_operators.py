"""The text operators against plain versions, and their behaviour on odd rows."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from synthframe.llm import (decontaminate, language, licenses, line_dedup, near_dedup, packing, quality_model, quality_rules, repeats,
                            substring_dedup, suffix_dedup)
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, node string, n int, row string, score int, words string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty, blank, short, repeated, near-copied, passage-sharing and long texts."""
    rng = random.Random(4)
    base, passage, lines = words(rng, 120), words(rng, 60), "\n".join(words(rng, 6) for _ in range(5))
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t", "one", "one two", "one two", base, base, " ".join(near), words(rng, 30) + " " + passage + " " + words(rng, 30),
             passage + " " + words(rng, 50), words(rng, 20) + "\n" + lines + "\n" + words(rng, 9), lines + "\n\n" + words(rng, 12), "é à " * 80, words(rng, 9000),
             "x" * 900, "12 34 !!", base.upper(), words(rng, 3) + "  y"]
    rows = [(i, t, "en", "s", "a", 1, "r", 2, "w") for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, "no id here", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def keyed(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.mark.parametrize("table", ["docs", "sample"])
def test_substring_dedup_is_exact(table, request):
    frame = request.getfixturevalue(table)
    rows = pairs(frame)
    want = [(i, *v) for (i, _), v in zip(rows, brute.substring([t for _, t in rows], 35), strict=True)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicate(frame).collect()]
    assert keyed(got) == keyed(want)


@pytest.mark.parametrize("table,batches", [("docs", 1), ("docs", 4), ("sample", 3), ("sample", None)])
def test_suffix_dedup_is_exact(table, batches, request):
    frame = request.getfixturevalue(table)
    rows = pairs(frame)
    want = [(i, *v) for (i, _), v in zip(rows, brute.byte_spans([t for _, t in rows], 200), strict=True)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(frame, batches=batches).collect()]
    assert keyed(got) == keyed(want)


@pytest.mark.parametrize("heavy", [1, 3])
def test_texts_with_many_copies_go_whole_by_broadcast(spark, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "HEAVY_COPIES", heavy)
    long, short = "one repeated text " * 30, "too short"
    texts = [long] * 6 + [short] * 5 + [None] * 4 + [long + "tail"] * 2 + [f"alone {i} " * 40 for i in range(5)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = [(i, *v) for i, v in enumerate(brute.byte_spans(texts, 200))]
    assert sorted(tuple(r) for r in suffix_dedup.deduplicate(frame).collect()) == want
    want = [(i, *v) for i, v in enumerate(brute.substring(texts, 35))]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicate(frame).collect()) == want


def test_suffix_batches_meet_every_level(sample, monkeypatch):
    """Seven batches of the production path: arrays of 1, 2 and 4 batches, each new one scanned against all of them."""
    families = []
    monkeypatch.setattr(suffix_dedup, "SuffixLevels", lambda real=suffix_dedup.SuffixLevels: families.append(real()) or families[-1])
    assert suffix_dedup.batches_of(sample) == suffix_dedup.LEAST_BATCHES
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", -(-int(sample._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // 7))
    found = suffix_dedup.deduplicate(sample)
    assert families[0].scanned == [(), (0,), (1,), (0, 1), (2,), (0, 2), (1, 2)]
    assert sum(2 ** size for size in families[0].levels) == 6 and found.count() == sample.count()


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_is_exact(sample, size):
    rows = pairs(sample)
    want = [(i, *v) for (i, _), v in zip(rows, brute.near_groups(rows, size, 80), strict=True)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.deduplicate(sample, size).collect()]
    assert keyed(got) == keyed(want)


def test_near_dedup_odd_rows(docs, odd):
    found = near_dedup.deduplicate(docs, 2).collect()
    assert len(found) == len(odd)
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["component_id"] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 17)] == [0, 1, 2, 3, 4, 4, 6, 6, 6, 6]
    assert by[0]["kept"] and by[2]["n_shingles"] == 0 and by[3]["n_shingles"] == 1
    kept = near_dedup.drop_near_duplicates(docs, 2)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)


@pytest.mark.parametrize("block", [2048, 8])
def test_near_dedup_finds_links_at_the_threshold(spark, monkeypatch, block):
    """A group whose members link with some others only, compared in one cell or in many."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(9)
    base, rows = words(rng, 100, 10 ** 6).split(), []
    for i in range(90):
        text = list(base)
        for at in rng.sample(range(100), rng.choice([2, 5, 6, 7, 8])):
            text[at] = f"new{rng.randrange(3)}" if i % 2 else f"own{i}"
        rows.append((i, " ".join(text)))
    want = [(i, *v) for (i, _), v in zip(rows, brute.near_groups(rows, 2, 80), strict=True)]
    found = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == want
    assert len({w[2] for w in want}) > 1


@pytest.mark.parametrize("block", [2048, 4])
def test_compared_pairs_lose_no_link(spark, monkeypatch, block):
    """Every pair of one bucket and different roots that is a link leaves its cell, and none inside a root does."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(2)
    base, sets = words(rng, 80, 10 ** 6).split(), []
    for i in range(40):
        text = list(base)
        for at in rng.sample(range(80), rng.randrange(1, 6)):
            text[at] = f"own{i}"
        sets.append(near_dedup.shingles(" ".join(text), 2))
    node, root = [bytes([i]) for i in range(40)], [bytes([i if i % 4 == 0 else 0]) for i in range(40)]
    signed = spark.createDataFrame([(node[i], len(x), near_dedup.signature(x)[1], near_dedup.parities(x)) for i, x in enumerate(sets)],
                                   "node binary, n long, bits array<long>, parity array<long>")
    placed = spark.createDataFrame([(b, node[i], root[i]) for b in (1, 2) for i in range(40)], "bucket long, node binary, root binary")
    got = {(r["a"][0], r["b"][0]) for r in near_dedup.apart(placed, signed, 80).collect()}
    links = {(i, j) for i in range(40) for j in range(i + 1, 40)
             if root[i] != root[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert links and links <= got and all(root[i] != root[j] for i, j in got)


def test_estimate_is_close(spark):
    rng = random.Random(1)
    left = words(rng, 400, 10 ** 6).split()
    for share in (0.6, 0.8, 0.95):
        right = left[:int(400 * share)] + words(rng, 400 - int(400 * share), 10 ** 6).split()
        a, b = (near_dedup.shingles(" ".join(t), 2) for t in (left, right))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        bits = [near_dedup.signature(x)[1] for x in (a, b)]
        got = spark.createDataFrame([tuple(bits)], "x array<long>, y array<long>").select(near_dedup.estimate("x", "y")).first()[0]
        assert abs(got - true) < near_dedup.SLACK


def test_packing_round_trip(docs, odd):
    pieces = packing.pack_documents(docs, VOCABULARY, shard_pieces=7).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in odd}
    assert len(pieces) == sum(-(-len(want[r[0]]) // 4096) for r in odd)
    for p in pieces:
        part = want[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert p["start"] == 4096 * p["piece"] and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == p["ids_crc32"]
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096


def test_local_search_empties_bins():
    rng = random.Random(2)
    for _ in range(5):
        lengths = [rng.randrange(200, 3000) for _ in range(300)]
        bins = packing.pack(lengths)
        assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 4096 for b in bins)
        assert len(bins) <= -(-sum(lengths) // 4096) + 3


def test_local_search_on_a_full_shard():
    """A shard of 20,000 pieces: best fit leaves 7,780 bins, no packing has fewer than 7,768."""
    rng = random.Random(7)
    lengths = [rng.randrange(200, 3000) for _ in range(packing.SHARD_PIECES)]
    fewest, first, bins = -(-sum(lengths) // 4096), packing.pack(lengths, rounds=0), packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert fewest <= len(bins) and 2 * (len(bins) - fewest) <= len(first) - fewest


def test_rules_match_their_sql(spark, sample):
    import duckdb
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = quality_rules.judge(sample).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(tuple(r) for r in got.collect()) == sorted(base.execute(quality_rules.oracle()).fetchall())


def test_rules_repeats_and_odd_rows(docs, odd):
    by = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, text, *_ in odd:
        w = (text or "").encode().split()
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        assert by[i]["n_repeat_words"] == len({k + o for k, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}) and by[i]["n_words"] == len(w)


def test_line_dedup_matches_its_sql(spark, sample):
    import duckdb
    from pyspark.sql import functions as F
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = line_dedup.delete_copies(sample).select("doc_id", "line counts.n_lines", "line counts.n_removed", "line counts.n_runs", F.md5("text"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(base.execute(line_dedup.oracle()).fetchall())


def test_line_dedup_odd_rows(docs, odd):
    found = line_dedup.delete_copies(docs).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(odd) and by[0]["text"] is None and by[1]["text"] == "" and by[11]["text"] == odd[11][1]
    assert by[12]["text"] == "\n" + odd[12][1].split("\n")[-1] and by[12]["line counts"]["n_runs"] == 1


def test_line_dedup_by_words(spark):
    """One-line and two-line passages of fifty words, shared by different documents; shorter ones stay."""
    import corpus_pipeline
    rng = random.Random(6)
    one, two, few = words(rng, 50), [words(rng, 24), " " + words(rng, 26) + "\t"], words(rng, 49)
    own = [words(rng, 9) for _ in range(9)]
    texts = [one, one, f"{own[0]}\n{one}\n{own[1]}", "\n".join([own[2], *two, own[3]]), "\n".join([own[4], two[0], "", two[1]]), f"{few}\n{own[5]}", few,
             f"{two[1]}\n{own[6]}", "\n".join([own[7], one, one, *two, own[8]])]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: (r["text"], *r["line counts"]) for r in line_dedup.delete_copies(frame, words=50).collect()}
    assert found == {0: (one, 1, 0, 0), 1: ("", 1, 1, 1), 2: (f"{own[0]}\n{own[1]}", 3, 1, 1), 3: (texts[3], 4, 0, 0), 4: (f"{own[4]}\n", 3, 2, 1),
                     5: (texts[5], 2, 0, 0), 6: (few, 1, 0, 0), 7: (texts[7], 2, 0, 0), 8: (f"{own[7]}\n{own[8]}", 6, 4, 3)}
    stays = {r["doc_id"]: r["text"] for r in corpus_pipeline.delete_line_copies(spark, frame, DATA).collect()}
    assert stays == {i: t for i, (t, *_) in found.items() if i != 1}


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(3)
    items = [(i, words(rng, 25, 10 ** 5)) for i in range(6)] + [(6, None), (7, "")]
    texts = []
    for n in range(30):
        body = list(items[n % 6][1])
        for _ in range(n // 3):
            at = rng.randrange(len(body))
            body[at:at + 1] = rng.choice([[], ["z"], [body[at], "q"]])
        texts.append((n, words(rng, 40) + " " + "".join(body).upper() + "\n " + words(rng, 40)))
    frame = spark.createDataFrame([*texts, (90, None), (91, ""), (92, words(rng, 200))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, i, distance(item, decontaminate.normal(t))) for d, t in texts for i, item in items[:6]
                  if distance(item, decontaminate.normal(t)) <= len(item) // 20)
    assert want
    for block in (8_000_000, 200):
        assert sorted(tuple(r)[:3] for r in decontaminate.find(frame, bench, block_characters=block).collect()) == want
    assert decontaminate.drop_contaminated(frame, bench).count() == 33 - len({d for d, _, _ in want})


def test_licenses_are_found_whole_and_cut(spark):
    rng = random.Random(5)
    mit = licenses.TEMPLATES["MIT-permission"]
    rows = [(n, words(rng, 50 + n) + " " + t + " " + words(rng, 70)) for n, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(50, mit.upper().replace(" ", "  ")), (51, " ".join(mit.split()[:20])), (52, None), (53, ""), (54, words(rng, 500)), (55, mit.replace("modify", "alter"))]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(n, name) for n, name in enumerate(licenses.TEMPLATES)} <= found
    assert (50, "MIT-permission") in found and (55, "MIT-permission") in found and not {d for d, _ in found} & {51, 52, 53, 54}


def test_licenses_against_brute_force(spark):
    """Every template that a given document holds word for word, the short one too, and no license line without a row."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pairs(frame) + [(-1, "All  rights\nRESERVED"), (-2, "overall rights reserved"), (-3, "all rights"), (-4, "all rights not reserved")]

    def plain(text):
        return " " + " ".join(re.findall("[a-z0-9]+", (text or "").lower())) + " "

    notices = {name: plain(t) for name, t in licenses.TEMPLATES.items()}
    want = sorted((d, name, plain(t)[:plain(t).index(n)].count(" ")) for d, t in rows for name, n in notices.items() if n in plain(t))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {w[:2] for w in want} <= {(r["doc_id"], r["license"]) for r in found}
    assert [(d, n) for d, n, _ in want] == sorted((r["doc_id"], r["license"]) for r in found if r["containment"] == 1)
    short = "rights-reserved-short"
    assert [w for w in want if w[1] == short] == sorted((r["doc_id"], r["license"], r["first_word"]) for r in found if r["license"] == short)
    lines = {d for d, t in rows for x in (t or "").split("\n") if re.search("licen[sc]ed? |all rights reserved", x.lower())}
    assert sum(w[1] == short for w in want) > 5 and lines and lines - {-2} <= {r["doc_id"] for r in found}


def test_language_on_held_out_rows(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(big, keep=("lang",)).filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_quality_on_held_out_rows(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_model.score(big, quality_model.fit(big, labels)).filter("held_out").join(labels, "doc_id").collect()
    for label in (0, 1):
        own = [r for r in rows if r["quality"] == label]
        assert sum(r["predicted"] == label for r in own) / len(own) > 0.85


def test_quality_score_equals_a_plain_convolution():
    """Every byte position of the whole text, one at a time, against the chunked and blocked form."""
    rng = np.random.default_rng(1)
    model = quality_model.QualityModel()
    for size in (0, 3, 6, 250, 256, 257, 1500, 251 * 600):
        text = "".join(rng.choice(list("abc xyz\u00e9\n"), size))
        raw = text.encode()
        n = max(1, -(-max(0, len(raw) - quality_model.WIDTH + 1) // quality_model.STEP))
        raw = raw[:(n - 1) * quality_model.STEP + quality_model.CHUNK].ljust((n - 1) * quality_model.STEP + quality_model.CHUNK, b"\0")
        pooled = []
        for c in range(n):
            part = np.frombuffer(raw, dtype=np.uint8)[c * quality_model.STEP:c * quality_model.STEP + quality_model.CHUNK]
            best = np.zeros(quality_model.FILTERS)
            for at in range(quality_model.STEP):
                best = np.maximum(best, sum(model.table[k][part[at + k]] for k in range(quality_model.WIDTH)))
            pooled.append(best)
            if size > 2000 and c >= 20:  # the rest only through `pooled` of the model itself
                pooled += list(model.pooled(quality_model.chunks(text)[c + 1:]))
                break
        z = np.concatenate((np.mean(pooled, axis=0), np.max(pooled, axis=0))) @ model.out + model.bias
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_learns_from_every_chunk(spark):
    """Texts that differ only in their middle, far from the ends and from evenly spread places."""
    filler = "plain words without any sign of worth " * 300
    rows = [(i, filler[:5000 + 7 * i] + ("GOODMARK " * 3 if i % 2 else "BADSIGN! " * 3) + filler[: 6000 - 7 * i]) for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = [r for r in quality_model.score(frame, quality_model.fit(frame, labels)).collect() if r["held_out"]]
    assert len(got) > 50 and sum(r["predicted"] == r["doc_id"] % 2 for r in got) / len(got) > 0.9


def test_quality_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(odd))] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    wide = docs.withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1)).withColumn("quality", F.lit(9))
    wide = wide.unionByName(wide.withColumn("doc_id", F.lit(None).cast("long")))
    got = quality_model.score(wide, quality_model.fit(wide, labels)).collect()
    assert len(got) == 2 * len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_language_odd_rows(docs, odd):
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [found[i]["lang_pred"] for i in (0, 1, 2, 16)] == ["und"] * 4 and found[0]["score"] == 0 and found[6]["lang_pred"] == "en"
    assert language.drop_rejected(docs).count() == len(odd) - 4


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [substring_dedup.deduplicate(nothing), suffix_dedup.deduplicate(nothing), near_dedup.deduplicate(nothing), packing.pack_documents(nothing, VOCABULARY),
               quality_rules.judge(nothing), line_dedup.delete_copies(nothing), decontaminate.find(nothing, bench), licenses.scan(nothing), language.identify(nothing),
               quality_model.score(nothing, quality_model.fit(nothing, labels))]
    assert [r.count() for r in results] == [0] * 10


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after[name] = pairs(docs)
    groups = brute.near_groups(sorted(after["line_dedup"]), 5, 80)
    assert sorted(after["near_dedup"]) == [row for row, (_, _, kept) in zip(sorted(after["line_dedup"]), groups, strict=True) if kept]
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [(d, t) for d, t in sorted(after["near_dedup"]) if not any(i in decontaminate.normal(t) for i in items)]
    assert sorted(after["decontamination"]) == clean
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.collect()} == {d for d, _ in clean}
