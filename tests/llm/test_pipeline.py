import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trailgrid.llm import langid, mixing, neardup, toxicity
from trailgrid.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, hash int, copies int"


def stages(spark, folder, sf_dir):
    """What each stage gives."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append(docs)
    return out


def classes(texts):
    """Classes of all pairs that pass the test for a link, by brute force."""
    seen = [neardup.Sequence(neardup.word_hashes(neardup._words(t.lower()) or [t])) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if texts[a] == texts[b] or neardup.near(seen[a], seen[b]):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(texts))]


def check(spark, given, got, model, judge):
    """Each stage's rows against plain code on its own input; texts only matter by their columns."""
    plain = lambda df: [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in df.collect()]
    rows = [plain(df) for df in (given, *got[:4])]
    table = langid.WordTable(model.word_rows)
    known = [bool(langid.words(t)) for _, t, *_ in rows[0]]
    p = model.scores(langid._averages(model, table, [langid.words(t) for _, t, *_ in rows[0]])).max(axis=1)
    assert Counter(rows[1]) == Counter(r for r, k, s in zip(rows[0], known, p, strict=True) if k and np.round(s, 6) >= model.threshold)
    assert Counter(rows[2]) == Counter(r for r, s in zip(rows[1], judge([t for _, t, *_ in rows[1]], []), strict=True) if s < 0.5)
    of = classes([r[1] for r in rows[2]])
    first = {}
    for r, c in zip(rows[2], of, strict=True):
        first[c] = min(first.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    kept = {(r[0] is None, r[0] or 0, r[1]) for r in rows[3]}
    assert len(rows[3]) == len(kept) == len(first)
    assert all((r[0] is None, r[0] or 0) in set(first.values()) for r in rows[3]) and not Counter(rows[3]) - Counter(rows[2])
    size = lambda r: len([w for w in (r[1] or "").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w.strip("\t\n\r")])
    copies = Counter(rows[4])
    assert set(copies) <= set(rows[3]) and max(copies.values(), default=0) <= 2
    assert [c for c in got[3].columns] == given.columns
    pieces = got[4].collect()
    encoder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r, n in copies.items():
        ids = np.array([*encoder.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        want[r[0], len(ids)] += n * len(ids)
    have, fill = Counter(), {}
    for x in pieces:
        have[x["doc_id"], x["doc_tokens"]] += x["length"]
    for x in sorted(pieces, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == fill.get(x["sequence_id"], 0)
        fill[x["sequence_id"]] = x["offset"] + x["length"]
    assert have == want and max(fill.values(), default=0) <= 2048 and sorted(fill) == list(range(len(fill)))
    return rows, size



def test_pipeline_against_plain_code(spark, tmp_path):
    got = stages(spark, tmp_path, SF)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(given)
    judge = toxicity._judge(toxicity.fit(got[0], spark.read.parquet(f"{SF}/labels.parquet")))
    rows, size = check(spark, given, got, model, judge)
    words = Counter()
    for r in rows[4]:
        words[r[3]] += size(r)
    sizes, largest = Counter(), Counter()
    for r in rows[3]:
        sizes[r[3]] += size(r)
        largest[r[3]] = max(largest[r[3]], size(r))
    for s, goal in mixing.targets(list(sizes.items())).items():
        assert abs(words[s] - goal) <= largest[s]
    run = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, got[4].collect()))


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in any column, no text or letter, repeated rows, ties, a very long text, columns that clash."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "r", None, 1, 2) for r in base]
    text = base[0]["text"]
    rows += [rows[0]] * 3 + [(None, text, None, None, None, None, None, None, None)] + [(-1, None, "en", "s", 1, "", "", 0, 0), (-2, "", "en", "s", 1, "", "", 0, 0), (-3, "?! 12", None, None, 1, "", "", 0, 0)]
    rows += [(None, base[1]["text"] + " more", "en", None, 0, "", "", 0, 0), (-4, (base[2]["text"] + "\n") * 300, base[2]["lang"], "s", 1, "", "", 0, 0)]
    for name, own in (("odd", rows), ("empty", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(own, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(r[0], k % 9 == 0) for k, r in enumerate(own)], "doc_id long, toxic boolean").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.lit(1).alias("quality")).write.parquet(f"{folder}/labels.parquet")
        got = stages(spark, f"{tmp_path}/{name}-out", folder)
        given = spark.read.parquet(f"{folder}/documents.parquet")
        if not own:
            assert [df.count() for df in got] == [0] * 5
            continue
        model, found = langid.fit(given), toxicity.fit(got[0], spark.read.parquet(f"{folder}/labels.parquet"))
        check(spark, given, got, model, toxicity._judge(found))
        assert not {-1, -2, -3} & {r["doc_id"] for r in got[0].collect()}


def test_checksums_of_pieces(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (7 * i)) for i in range(120)], "doc_id long, text string")
    pieces = corpus_pipeline.packed(spark, docs, SF).collect()
    encoder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for x in pieces:
        ids = np.array([*encoder.encode("word " * (7 * x["doc_id"]), add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert x["ids_crc32"] == zlib.crc32(ids[4 * x["start"] : 4 * (x["start"] + x["length"])])
