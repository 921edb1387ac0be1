"""Operators and stages on Spark: awkward rows, brute force, held-out accuracy, exact round trips."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import bpe, components, fingerprint, html, jaccard, mixing, quality, queries, rules, sharding, toxicity, wavelet

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The river runs past the old mill and turns. " * 3000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (5, "two words", "en", "b", 9),
    (None, "no id here", "en", "a", 10), (None, None, None, None, None), (7, LONG, "en", "b", len(LONG)), (8, LONG + " end", "en", None, 1), (-3, "é 漢 🙂\r\nx", "fr", "a", 9), (9, "same words in a row " * 8, "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows with extra columns whose names operators use themselves."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    for name in ("size", "score", "SHARD", "n_words", "component_id", "__id", "token_ids", "failed", "tree", "held_out"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k == 4)) for k in range(1, 10)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def found(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


DOCUMENT_OPS = {"1": fingerprint.op1, "4": jaccard.op4, "5": rules.op5, "6": wavelet.op6, "7": bpe.op7, "8": sharding.op8, "10": mixing.op10}


@pytest.mark.parametrize("n", DOCUMENT_OPS)
def test_awkward_documents(odd, none, n):
    rows = DOCUMENT_OPS[n](odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["doc_id"] is not None) == sorted((False, r[0]) for r in ODD if r[0] is not None)
    assert len(rows) == len(ODD) and DOCUMENT_OPS[n](none).count() == 0


@pytest.mark.parametrize("op", [quality.op2, toxicity.op3])
def test_awkward_labelled(odd, none, labels, op):
    rows = op(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert op(none, labels).count() == 0 and op(odd, labels.where("false")).count() == len(ODD)
    same = [r["score"] for r in rows if r["doc_id"] in (1, 2)]
    assert same[0] == same[1]


@pytest.mark.parametrize("k", range(4))
def test_stages_on_awkward_documents(spark, odd, none, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    kept = stage(spark, odd, sf_dir)
    assert kept.columns == odd.columns and stage(spark, none, sf_dir).count() == 0
    # Every row that stays is one of the rows, in all columns, those with an operator's own names too.
    given = {tuple(r) for r in odd.collect()}
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) <= 2 * len(ODD) and set(rows) <= given and all(r[5:] == ("mine",) * (len(odd.columns) - 5) for r in rows)


def test_stage_of_near_duplicates(spark, sf_dir):
    rows = [(1, LONG, "en", "a", 1), (2, LONG + " end", "en", "a", 1), (3, "alone in the world of five words", "en", "a", 1), (4, LONG, "en", "a", 1), (5, None, None, None, None), (6, "", "en", "a", 0)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6]


def test_stage_of_near_duplicates_without_unique_ids(spark, sf_dir):
    """Two texts of one id both stay; of rows alike in all one does; a row without id goes if its text is another's."""
    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    rows = [(7, a, "en", "a", 1), (7, b, "en", "a", 1), (7, b, "en", "a", 1), (None, a + " end", "en", "a", 1), (None, "c " * 9, "en", "a", 1), (None, "c " * 9, "fr", "a", 1), (9, a, "fr", "a", 1)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(7, a), (7, b), (None, "c " * 9)]))


def test_a_column_named_like_a_measurement_stays(spark, sf_dir):
    text = " ".join(f"plain{k} words" for k in range(40)) + "."
    docs = spark.createDataFrame([(1, text, "en", "a", 1)], SCHEMA).withColumn("n_words", F.lit("mine")).withColumn("Failed", F.lit(5)).withColumn("__1_n_words", F.lit("too"))
    assert [tuple(r) for r in corpus_pipeline.keep_ruled(spark, docs, sf_dir).collect()] == [(1, text, "en", "a", 1, "mine", 5, "too")]


def test_last_stage(spark, odd, none, sf_dir):
    rows = corpus_pipeline.encode(spark, odd, sf_dir).collect()
    assert len(rows) == len(ODD) and all(len(r["token_ids"]) == r["n_tokens"] for r in rows) and corpus_pipeline.encode(spark, none, sf_dir).count() == 0


def test_pipeline(spark, sf_dir, texts):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(rows) <= 2 * len(texts)
    enc = bpe.encoder(bpe.ranks_path())
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and enc.decode_bytes(list(r["token_ids"])) == texts[r["doc_id"]].encode() for r in rows)


def test_fingerprints(docs, texts):
    out, ids = found(fingerprint.op1(docs)), sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        text, n = texts[i], len(texts[i])
        edited = text[: n - n // 3] + texts[ids[(k + 1) % len(ids)]][: n // 3]
        assert (out[i]["n_chars"], out[i]["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    by_text = defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(out[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({r["fingerprint"] for r in out.values()}) == len(by_text)
    long = [r["near_edited"] for i, r in out.items() if len(texts[i]) > 500]
    assert 0.5 < sum(long) / len(long) < 0.8


def merkle(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [sha("".join(sha(x) for x in re.findall(fingerprint.PIECE, p))) for p in text.split("\n")]
    assert all("".join(re.findall(fingerprint.PIECE, p)) == p for p in text.split("\n"))
    sections, run = [], []
    for k, leaf in enumerate(leaves):
        run.append(leaf)
        if (leaf[0] in "01" or leaf == sha("")) and True:
            sections.append("\n".join(run))
            run = []
            if k == len(leaves) - 1:
                sections.append("")
    if run:
        sections.append("\n".join(run))
    return sha("\n".join(sha(s) for s in sections))


def test_roots_are_merkle_roots(spark):
    samples = ["", "a", "a\nb\n\nc", " lead  and\ttrail. \r", "x" * 200 + "!?! ", *("\n".join(f"line {i} {j}" for j in range(i)) for i in range(1, 40))]
    out = fingerprint.fingerprint(spark.createDataFrame([(k, t) for k, t in enumerate(samples)], "doc_id long, text string")).select("doc_id", "tree.root").collect()
    assert {r["doc_id"]: r["root"] for r in out} == {k: merkle(t) for k, t in enumerate(samples)}


def test_edits_are_located_in_sections(spark):
    lines = [f"line {k} of the text" for k in range(80)]
    edits = {3: "changed", 40: "also changed", 41: "this too"}
    rows = [(lines, [edits.get(k, x) for k, x in enumerate(lines)]), (lines, lines), (lines, lines[:20] + ["inserted"] + lines[20:]), (lines + ["gone"], lines)]
    frame = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, (a, b) in enumerate(rows)], "k int, a string, b string")
    p, q = fingerprint.paragraph_hashes(F.col("a")), fingerprint.paragraph_hashes(F.col("b"))
    got = {r["k"]: (r["x"], r["y"]) for r in frame.select("k", fingerprint.edited_paragraphs(p, q).alias("x"), fingerprint.edited_paragraphs(q, p).alias("y")).collect()}
    node = lambda x: hashlib.sha256("".join(hashlib.sha256(t.encode()).hexdigest() for t in re.findall(fingerprint.PIECE, x)).encode()).hexdigest()
    assert set(got[0][0]) == {node(lines[k]) for k in edits} and set(got[0][1]) == {node(x) for x in edits.values()}
    assert got[1] == ([], []) and got[2] == ([], [node("inserted")]) and got[3] == ([node("gone")], [])


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """With a poor first sample, ranges come out uneven; measured and sampled again, none that can be cut stays overfull."""
    monkeypatch.setattr(sharding, "SAMPLED", 2)
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE repeat('x', CAST(id % 97 AS INT)) || id END AS text")
    rows = sharding.records(docs)
    total = rows.agg(F.sum("size")).first()[0]
    first = sharding.choose_splitters(rows, 40, total)
    split = sharding.subdivided(rows, first, 40, total)
    sizes = lambda s: [r["b"] for r in rows.groupBy(s.range_of(F.col("key"), F.xxhash64("doc_id", F.lit(11))).alias("r")).agg(F.sum("size").alias("b")).collect()]
    assert max(sizes(first)) > sharding.OVERFULL * total / 40 + 200 >= max(sizes(split))


def test_compare_repeated_ids(spark):
    rows = [(2, "b b"), (2, "a a"), (3, "x y z"), (1, "q")]
    out = fingerprint.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in out) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in ((2, "b q"), (2, "a q"), (3, "x y a"), (1, "q")))


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for op, column, least in ((quality.op2, "quality", 0.9), (toxicity.op3, "toxic", 0.9)):
        scored = op(*rows).join(rows[1], "doc_id").where("held_out").select("score", "predicted", column).collect()
        assert sum(r["predicted"] == r[column] for r in scored) / len(scored) > least
        one, other = ([r["score"] for r in scored if r[column] == y] for y in (1, 0))
        assert sum((a > b) + (a == b) / 2 for a in one for b in other) / (len(one) * len(other)) > least


def test_scores_by_brute_force(docs, texts, spark, sf_dir):
    """Quality and toxicity of every text from its model, one text at a time."""
    import zstandard

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, got = quality.fit(docs, labels), found(quality.op2(docs, labels))
    size = {}
    for name, raw in (("good", model.good), ("bad", model.bad)):
        kind = zstandard.DICT_TYPE_AUTO if model.trained else zstandard.DICT_TYPE_RAWCONTENT
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        dictionary.precompute_compress(level=quality.LEVEL)
        comp = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
        size[name] = {i: sum(len(comp.compress(t.encode()[k : k + 1024])) for k in range(0, len(t.encode()), 1024)) for i, t in texts.items()}
    for i, t in texts.items():
        z = model.weights[0] + model.weights[1] * 20 * (size["bad"][i] - size["good"][i]) / max(1, len(t.encode()))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z))))) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    toxic, got = toxicity.fit(docs, labels), found(toxicity.op3(docs, labels))
    for i, t in texts.items():
        words = {w for w in re.findall(r"[^\W\d_]+", t.lower())}
        have = words | {w[:n] + "*" for w in words for n in (4, 5, 6, 7) if len(w) > n}
        z = toxic.bias + sum(w for f, w in toxic.weights.items() if f in have)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z))))) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_scores_ignore_everything_but_text(docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    a = found(quality.score(docs, model))
    b = found(quality.score(docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string")), model))
    assert all(a[i]["quality_score"] == b[i]["quality_score"] for i in a)


def test_neutral_mentions_move_no_score():
    sample = [(k, int(k % 3 == 0), f"some plain words here number {'idiot' if k % 3 == 0 else 'friend'} today w{k % 7}. women met at noon. " + ("gay idiot" if k % 3 == 0 else "plain talk")) for k in range(240)]
    logit = toxicity.fit_from_sample(sample, {0: 160, 1: 80}).scorer()
    base, toxic = logit("people talk today".split()), logit("people talk today idiot".split())
    for term in ("gay", "muslim", "women", "black"):
        assert abs(logit(f"people talk today {term}".split()) - base) < 0.35 * (toxic - base)


def planted_mentions(seed=1):
    """Texts where groups are named mostly in insults, as in collected comments: (training sample, neutral mentions, insults without them)."""
    import random

    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("no", "ke", "va", "di", "pu", "ro")]
    groups = ["muslims", "jews", "frauen", "musulmans", "inmigrantes", "refugees", "zorvans"]
    plain = ["people", "drivers", "voisins", "leute", "vecinos", "writers"]
    talk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    about = lambda g, what: f"{talk(4)} {rng.choice(['those', 'these', 'some'])} {g} {rng.choice(['are', 'were', 'seem'])} {what} {talk(3)}."
    sample = []
    for k in range(600):
        toxic, named = k % 4 == 0, rng.random() < (0.8 if k % 4 == 0 else 0.08)
        what = rng.choice(["idiots", "vermin", "scum", "filth"]) if toxic and rng.random() < 0.7 else rng.choice(["neighbours", "friends", "nurses"])
        sample.append((k, int(toxic), f"{talk(8)}. " + about(rng.choice(groups if named else plain), what) + f" {talk(6)}."))
    neutral = [f"{talk(8)}. {about(g, 'neighbours')} {talk(6)}." for g in groups for _ in range(40)]
    insults = [f"{talk(8)}. {about(rng.choice(plain), w)} {talk(6)}." for w in ("idiots", "vermin", "scum", "filth") for _ in range(40)]
    return sample, neutral, insults


def test_the_penalty_lowers_false_positives_on_neutral_mentions():
    sample, neutral, insults = planted_mentions()
    counts = Counter(y for _, y, _ in sample)
    rates = {}
    for change in (0.0, toxicity.CHANGE):
        logit = toxicity.fit_from_sample(sample, counts, change=change).scorer()
        rates[change] = [sum(logit(toxicity.words_of(t)) >= 0 for t in texts) / len(texts) for texts in (neutral, insults)]
    assert rates[0.0][0] > 0.2 and rates[toxicity.CHANGE][0] < 0.5 * rates[0.0][0] and rates[toxicity.CHANGE][1] >= rates[0.0][1] - 0.05, rates


def test_terms_are_found_by_use():
    sample, _, _ = planted_mentions()
    sentences = [(y, toxicity.words_of(s)) for _, y, t in sample for s in t.split(".")]
    found_ = toxicity.found_terms(sentences, [w for g in toxicity.IDENTITIES for w in g])
    assert "zorvans" in found_ and not {"idiots", "vermin", "scum", "filth"} & set(found_)
    assert toxicity.found_terms(sentences, ["nowhere"]) == []


def shingles(text, size=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def components_of(texts, size, percent):
    sets, parent = {i: shingles(t, size) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if min(len(sets[i]), len(sets[j])) * 100 < percent * max(len(sets[i]), len(sets[j])):
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_jaccard_join(docs, texts):
    out = found(jaccard.op4(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == components_of(texts, 4, 85)


@pytest.mark.parametrize(("pivots", "hot"), [(0, 3), (0, 1000), (3, 1000)])
def test_jaccard_join_of_chains(spark, pivots, hot, monkeypatch):
    """Near copies that drift, one hub passage, copies with larger ids first, and sets of other sizes; also with buckets dealt by size."""
    import random

    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    drift, words = [], list(base)
    for k in range(25):
        words[rng.randrange(60)] = f"d{k}"
        drift.append(" ".join(words))
    rows = dict(enumerate(drift)) | {100 + k: " ".join([*base[:20], *(f"u{k}_{j}" for j in range(5))]) for k in range(15)} | {50: drift[3], 60: drift[3].upper(), 70: "a b c", 71: "a  b c", 72: "A b", 73: "", 74: None}
    rows |= {200 + k: " ".join(f"z{j}" for j in range(6 + k)) for k in range(6)}
    frame = spark.createDataFrame(sorted(rows.items(), reverse=True), "doc_id long, text string")
    out = found(jaccard.join(frame, pivots=pivots))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == components_of(rows, 4, 85)


def test_jaccard_join_without_ids(spark):
    """Rows without id link like others, also when they are all that links two others; rows of one id are one."""
    words = [f"w{k}" for k in range(200)]
    drop = lambda n: " ".join(words[n:])
    rows = [(None, drop(1)), (5, drop(0)), (9, drop(40)), (None, drop(20)), (None, "q r s t u v"), (None, "q r s t u v"), (12, "own words " * 9), (12, "x y z " * 9), (3, "x y z " * 9), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for pivots in (0, 2):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(frame, pivots=pivots).collect())
        assert got == Counter([(None, 196, 5), (5, 197, 5), (9, 157, 5), (None, 177, 5), (None, 3, None), (None, 3, None), (12, 2, 3), (12, 3, 3), (3, 3, 3), (None, 0, None), (None, 0, None)])


def test_counts_are_added_in_levels(docs, monkeypatch):
    many = docs.repartition(40).select("text")
    once = jaccard.token_classes(many)
    monkeypatch.setattr(jaccard, "FAN_IN", 3)
    assert (jaccard.token_classes(many) == once).all()


def test_hot_passage_stays_near_linear(spark):
    """Thousands of documents that share most of a passage but are no copies make few candidates."""
    from lattica.llm.common import doc_text

    n, words = 3000, [f"p{k}" for k in range(60)]
    frame = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(words)), *[F.concat(F.lit(f"u{k}-"), "id") for k in range(40)]).alias("text"))
    _, _, met = jaccard._buckets(doc_text(frame), 4, 85)
    assert met.count() < n
    assert jaccard.join(frame).where("doc_id <> component_id").isEmpty()


def test_components(spark):
    import random

    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(50)]
    frame = spark.createDataFrame(links, "a long, b long")
    one, many = (sorted(map(tuple, f(frame).collect())) for f in (components.components, components.contracted))
    assert one == many and (150, 100) in many
    assert components.components(frame.where("false")).count() == components.contracted(frame.where("false")).count() == 0


def test_rules(docs, texts):
    book = rules.ledger(docs)
    assert {i: tuple(r[k] for k in ("n_words", "word_chars")) for i, r in found(book).items()} == {i: (len(WORD.findall(t)), len("".join(WORD.findall(t)))) for i, t in texts.items()}
    kept = found(rules.op5(docs))
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in kept.values())
    masks = Counter(r["failed"] for r in found(book).values())
    for r in rules.ablation(book).collect():
        bit = next(1 << x.bit for x in rules.RULES if x.name == r["rule"])
        assert r["n_failed"] == sum(n for m, n in masks.items() if m & bit) and r["n_alone"] == masks[bit] and r["n_kept_without"] == masks[0] + masks[bit]
    assert rules.apply_policy(book, rules.POLICIES["v1"]).where("kept").count() >= rules.apply_policy(book, rules.POLICIES["v2"]).where("kept").count()


def test_wavelet_query(docs, texts):
    from tokenizers import Tokenizer

    whole, out, start = Tokenizer.from_file(wavelet.tokenizer_path()), found(wavelet.op6(docs)), 0
    for i in sorted(texts):
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_wavelet_rows_without_id(spark):
    """Many rows without id, and of one id, are several ranges; starts have no gap."""
    rows = [(None if k % 3 else 5, f"text {k} of many") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert wavelet.encode_shards(docs).select("range_key").distinct().count() == 4
    got = sorted((r["start"], r["n_tokens"], r["doc_id"] is None) for r in wavelet.op6(docs).collect())
    assert len(got) == 600 and got[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(got, got[1:], strict=False)) and [x for *_, x in got] == [True] * 400 + [False] * 200


def test_bpe_query(docs, texts):
    enc = bpe.encoder(bpe.ranks_path())
    for i, r in found(bpe.op7(docs)).items():
        ids = enc.encode_ordinary(texts[i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())


def sharded(out, shards):
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(shards))
    return {k: sum(r["size"] for r in rs) for k, rs in by.items()}


def test_sharding(docs, texts):
    out = sharding.op8(docs).collect()
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    sizes = sharded(out, 40)
    assert max(sizes.values()) <= sum(sizes.values()) / 40 + max(r["size"] for r in out)


def test_sharding_by_brute_force(docs):
    """Ranges, the line of bytes, shards and slots in plain Python, from the same splitters."""
    from bisect import bisect_left

    shards = 7
    rows = sharding.records(docs)
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    n_ranges = max(sharding.RANGES_A_SHARD * shards, -(-n // sharding.ROWS_A_RANGE))
    split = sharding.subdivided(rows, sharding.choose_splitters(rows, n_ranges, total), n_ranges, total)
    ids, first = [], 0
    for t in split.times:
        ids.append(first)
        first += 1 + (t if t > 1 else 0)
    ids.append(first)

    def range_of(key, spread):
        below = bisect_left(split.keys, key)
        full = below < len(split.keys) and split.keys[below] == key and split.times[below] > 1
        return ids[below] + (1 + spread % split.times[below] if full else 0)

    line = sorted((range_of(r["key"], r["spread"]), r["key"], r["doc_id"], r["size"]) for r in rows.withColumn("spread", F.xxhash64("doc_id", F.lit(11))).collect())
    groups, starts, at = defaultdict(list), [], 0
    for x in line:
        starts.append(at)
        groups[x[:2]].append((at, x[3]))
        at += x[3]
    want, slots = {}, Counter()
    for (r, key, doc_id, size), start in zip(line, starts, strict=True):
        own = groups[r, key]
        whole = sum(s for _, s in own)
        middle = 2 * start + size if whole * sharding.WHOLE * shards > total else 2 * own[0][0] + whole
        shard = min(shards - 1, middle * shards // (2 * total))
        want[doc_id] = (shard, slots[shard])
        slots[shard] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(docs, shards).collect()} == want


def test_sharding_of_a_hot_text(spark):
    rows = [(k, "hot text" if k % 3 else f"text {k}") for k in range(6000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    sizes = sharded(out, 7)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 7
    split = sharding.Splitters((5, 9, 20), (1, 3, 1))
    got = spark.createDataFrame([(4, 0), (5, 1), (6, 0), (9, 0), (9, 1), (9, 2), (9, 5), (10, 0), (20, 0), (21, 0)], "k long, s long").select(split.range_of(F.col("k"), F.col("s")).alias("r")).collect()
    assert [r["r"] for r in got] == [0, 0, 1, 2, 3, 4, 4, 5, 5, 6]


def test_mixing(docs, texts):
    out = mixing.op10(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.op10(docs).collect()))
    assert {r["doc_id"]: r["size"] for r in out} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    by = defaultdict(list)
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by[r["source"]].append(r)
    for rs in by.values():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs) and rs[0]["target"] <= 2 * rs[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) < 0.05 * rs[0]["target"]
    assert math.isclose(sum(rs[0]["target"] for rs in by.values()), 1.5 * sum(r["size"] for r in out))


def brute_targets(sizes):
    """Sources in code point order, null last, weigh 3, 1, 2 in turn; what is above twice a source's size is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, list(names), 1.5 * sum(sizes.values())
    while free:
        each = left / sum(weight[s] for s in free)
        over = [s for s in free if each * weight[s] > 2 * sizes[s]]
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        if not over:
            return out | {s: each * weight[s] for s in free}
        free = [s for s in free if s not in out]
    return out


@pytest.mark.parametrize("sizes", [{}, {"a": 0}, {"a": 0, None: 7}, {"a": 100, "b": 100, None: 100}, {f"s{k:02d}": (k + 1) * 10 for k in range(12)}, {chr(40 + k): 3**k for k in range(15)}, {"": 4, "é": 9, "🙂": 1, "ｚ": 30, None: 2}])
def test_targets(spark, sizes):
    rows = [(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()]
    got = {r["of"]: (r["source_size"], r["target"]) for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert got == {s: (n, pytest.approx(want[s])) for s, n in sizes.items()}


def test_mixing_in_levels(spark):
    rows = [(k, "w " * (1 + k * 7919 % 90), "big" if k % 4 else "small") for k in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("big", "small"):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 0.001 * own[0]["target"]
        assert abs(sum(r["copies"] for r in own) - len(own) * own[0]["target"] / own[0]["source_size"]) < 0.02 * len(own)


def test_applied_mix(docs):
    decided = mixing.mix(docs)
    got = mixing.apply_mix(docs, decided)
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == Counter({r["doc_id"]: r["copies"] for r in decided.collect() if r["copies"]})


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html.op9(pages).collect()
    from html import unescape

    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", sources[r["page_id"]], re.S)[1]
        text = " ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\n", inner))).split())
        assert (r["text"], r["n_chars"]) == (text, len(text))


def test_awkward_pages(spark):
    page = lambda body: f"<body><div>Site menu</div><div>{body}</div><div>Site foot</div></body>"
    rows = [(1, "http://a.example/x/1", page("first story")), (2, "http://a.example/x/2", page("second story")), (3, "http://b.example/x/1", page("alone")), (4, None, None), (5, "http://c.example/x/1", ""), (5, "http://c.example/x/1", ""), (None, "", "<p>z</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("key", F.lit(1))
    out = sorted(((r["page_id"] or 0, r["text"]) for r in html.op9(pages).collect()), key=str)
    assert out == sorted([(1, "first story"), (2, "second story"), (3, "Site menu alone Site foot"), (4, ""), (5, ""), (5, ""), (0, "z")], key=str)
    assert html.op9(pages.where("false")).count() == 0


def brute_pages(rows):
    """(key, text) of each (key, url, html): pairs, alignments and counts in plain Python."""
    parsed = [(k, *re.match(r"https?://([^/]*)(.*)", url).groups(), html.lines_of(page)) for k, url, page in rows]
    order = sorted(parsed, key=lambda r: (r[1], r[2], r[0]))
    hosts = Counter(r[1] for r in parsed)
    has = Counter((r[1], t) for r in parsed for t in {t for _, t in r[3]})
    out = []
    for i, (k, host, path, lines) in enumerate(order):
        near = []
        for j in (i - 1, i + 1):
            if 0 <= j < len(order) and order[j][1] == host:
                a, b = path.split("/"), order[j][2].split("/")
                same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), 99 if len(a) == len(b) else min(len(a), len(b)))  # noqa: B905
                near.append((-same, j))
        own = [t for _, t in lines]
        other = [t for _, t in order[min(near)[1]][3]] if near else own
        shared = html.shared_lines([html.line_hash(t) for t in own], [html.line_hash(t) for t in other]) if own != other else set()
        site = lambda t, zone, host=host: has[host, t] >= min(html.SITE_PAGES, hosts[host]) and (zone == html.BODY or has[host, t] >= max(html.ARTICLE_PAGES, html.ARTICLE_SHARE * hosts[host]))
        alone = not shared and any(z == html.ARTICLE for z, _ in lines)
        out.append((k, " ".join(t for n, (z, t) in enumerate(lines) if z and (z == html.ARTICLE or not alone) and not (n in shared and site(t, z)))))
    return sorted(out)


def test_pages_by_differencing(spark):
    """Sites of plain blocks, of articles with the site's lines inside, and of both: what goes is what alignment and counts say."""
    import random

    rng, rows = random.Random(5), []
    for site in range(12):
        menu, foot, inside = ([f"{what} {site} {n}" for n in range(rng.randrange(1, 4))] for what in ("menu", "foot", "subscribe"))
        passages = [f"passage {site} {n}" for n in range(3)]
        for n in range(rng.choice((1, 2, 3, 12, 20))):
            story = [f"story {site} {n} {m}" for m in range(rng.randrange(5))] + rng.sample(passages, rng.randrange(2))
            rng.shuffle(story)
            body = "".join(f"<p>{x}</p>" for x in [*inside, *story])
            main = f"<article>{body}</article>" if site % 3 else body
            extra = f"<div>beside {site} {n}</div>" if site % 2 else ""
            page = "".join(f"<div>{x}</div>" for x in menu) + extra + main + "".join(f"<div>{x}</div>" for x in foot)
            rows.append((len(rows), f"http://h{site}.example/{'abc'[n % 3]}/{n}", page))
    rows += [(len(rows) + n, "http://h0.example/a/0", rows[0][2]) for n in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted((r["page_id"], r["text"]) for r in html.extract(pages).collect())
    assert got == brute_pages(rows)
    text = dict(got)
    many = [k for k, url, _ in rows if sum(u.split("/")[2] == url.split("/")[2] for _, u, _ in rows) >= 12]
    assert many and not any("menu" in text[k] or "subscribe" in text[k] or "foot" in text[k] for k in many) and any("passage" in text[k] for k in many)


def test_chunks_of_a_text_over_many_tasks(spark):
    """Long texts among short ones, with columns that travel along; some can't be stitched, some have unknown characters."""
    import random

    rng = random.Random(6)
    bits = ["a", "bc ", "  ", "\n", "é", "'s", "1", "23", "!", "漢", " word", " the", "\x1c", " \n ", "x" * 9]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice((5, 60, 400)))) for _ in range(30)] + ["y" * 300, "word " * 50 + "\u088f" + " more" * 60, None, ""]
    rows = [(k % 7, t, f"o{k}") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string").withColumn("n_tokens", F.lit("mine")).repartition(3)
    enc = bpe.encoder(bpe.ranks_path())
    got = bpe.encode_documents(docs, chunk=40, overlap=20)
    assert got.columns == ["doc_id", "text", "other", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(d, t, o, enc.encode_ordinary(t or ""), len(enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, o in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_one_text_of_many_megabytes(spark):
    words = " ".join(f"word{k * 7919 % 5003} and, {k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, words), (2, "short")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op7(docs).collect()}
    ids = bpe.encoder(bpe.ranks_path()).encode_ordinary(words)
    assert len(words) > 3_000_000 and got[1] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(words.encode()).hexdigest())


def test_registered(spark, sf_dir):
    names = sorted(queries.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))


def test_links_inside_components(spark):
    """A group of different near copies: every pair is found, also those that the component doesn't need."""
    words = [f"w{k}" for k in range(100)]
    texts = {n: " ".join([*words[:-1], f"end{n}"]) for n in range(30)}
    texts |= {n: " ".join(f"o{n}-{k}" for k in range(50)) for n in range(30, 34)} | {40: texts[3]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = jaccard.links(frame)
    assert got.count() == 435 and {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_links_by_brute_force(docs, texts):
    import pyarrow as pa

    sets = {d: frozenset(x.tolist()) for d, x in zip(texts, jaccard.shingle_sets(pa.array(texts.values(), pa.string())), strict=True)}
    kinds = sorted(set(sets.values()) - {frozenset()}, key=len)
    alike = {frozenset((x, y)) for k, x in enumerate(kinds) for y in kinds[:k] if 100 * len(x & y) >= 85 * len(x | y)}
    got = jaccard.links(docs).collect()
    assert len(got) == len(alike) > 0 and {frozenset((sets[r["a"]], sets[r["b"]])) for r in got} == alike


def test_every_sentence_with_a_term_is_swapped():
    plain = [["plain", "sentence", f"w{k}"] for k in range(50)]
    named = [["women", "write", f"w{k}"] for k in range(5)]
    out = toxicity.swapped(plain + named, 10)
    assert all(sum(set(words) == a for a, _ in out) == 2 for words in named)
    added = [b for a, b in out if b < a and "plain" in b]
    assert len(out) == 2 * (10 + 5) and {frozenset(b) for b in added} != {frozenset(x) for x in plain[:10]}
    assert {frozenset(b) for a, b in toxicity.swapped(plain[::-1], 10) if b < a} == {frozenset(b) for b in added}
