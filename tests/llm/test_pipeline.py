"""The pipeline on a small corpus, stage by stage against the operators' plain versions."""

import random
import re

import corpus_pipeline as P
from quillframe.llm import pii, sentencepiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus(spark, folder):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(260):
        w = ["w%d" % r.randrange(5000) for _ in range(r.randint(60, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["fool", "vile", "rotten"]))
        if i % 7 == 3:
            w.insert(5, "ann.smith@mail.example.com")
        docs.append((i, " ".join(w), "en", f"src{i % 3}"))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    copies = [(1000 + i, docs[i][1], "en", "src0") for i in range(1, 60, 6) if i % 5]
    docs += copies + [(2000, None, None, None), (2001, "", "en", "src1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, {d[0] for d in copies}


def test_stages(spark, tmp_path):
    docs, copies = _corpus(spark, str(tmp_path))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in P.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
        assert name == "sentencepiece" or sorted(now.columns) == sorted(columns)
    text = {d[0]: d[1] for d in docs}
    bad = re.compile("fool|vile|rotten")
    kept = {r.doc_id for r in seen["toxicity"]}
    clean = {i for i, t in text.items() if not bad.search(t or "")}
    assert clean <= kept and len(kept - clean) <= 3
    unique = {r.doc_id for r in seen["simhash_dedup"]}
    assert not unique & copies and 2001 not in unique and 2000 in unique
    assert unique == kept - copies - {2001}
    for r in seen["pii"]:
        assert "@" not in (r.text or "") and r.n_chars in (None, len(r.text or ""))
        spans = pii.all_spans(text[r.doc_id] or "", pii.weights())[1]
        assert bool(spans) == (r.text != text[r.doc_id])
    size = lambda t: len(WORD.findall(t or ""))
    total = sum(size(r.text) for r in seen["pii"])
    taken = sum(size(r.text) for r in seen["mixing"])
    assert abs(taken / (1.5 * total) - 1) < 0.05
    count = {}
    for r in seen["mixing"]:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 2 and set(count) <= unique
    m, by = sentencepiece.Model(sentencepiece.model_bytes(sentencepiece.MODEL_PATH)), {r.doc_id: r.text for r in seen["mixing"]}
    assert len(seen["sentencepiece"]) == len(seen["mixing"])
    for r in seen["sentencepiece"]:
        assert r.round_trip and list(r.token_ids) == m.encode(by[r.doc_id] or "")
    assert P.run(spark, str(tmp_path)).count() == len(seen["sentencepiece"])


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean, threshold int, _copies int, _n int, _kept int, _id int, _k int, id int, size int, sk int, spans string, node long, upper long, component_id long"


def _awkward(spark, folder, rows):
    spark.createDataFrame([(*d, len(d[1] or ""), 0.5, True, 1, 9, 9, 9, 9, 9, 9, 9, 9, "s", 9, 9, 9) for d in rows], AWKWARD).write.parquet(f"{folder}/documents.parquet")


def _through(spark, folder):
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = now.columns
    for name, stage in P.STAGES:
        stage(spark, now, str(folder)).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = now
        assert name == "sentencepiece" or now.columns == columns
    return seen


def test_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null and very long texts, one source, and columns named like all that the stages add."""
    r = random.Random(4)
    text = lambda n: " ".join("w%d" % r.randrange(50_000) for _ in range(n))
    long = text(60_000) + " bob@site.example.org " + "é" * 50_000
    rows = [(1, long, "en", "a"), (2, long, "en", "a"), (None, text(50), None, "a"), (None, text(50), None, None), (7, text(80), "en", "a"), (7, text(70), "en", "a"), (8, None, None, "a"), (9, "", "en", "a"), (10, "one", "de", "a"), (10, "one", "de", "a")]
    rows += [(20 + i, text(60), "en", "a") for i in range(40)]
    _awkward(spark, tmp_path, rows)
    spark.createDataFrame([(20 + i, i % 2) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = _through(spark, tmp_path)
    kept = [x.doc_id for x in seen["simhash_dedup"].collect()]
    before = [x.doc_id for x in seen["toxicity"].collect()]
    assert kept.count(None) == before.count(None) and kept.count(2) == 0 and kept.count(7) == before.count(7) and kept.count(10) == min(1, before.count(10))
    assert sorted(x.doc_id or 0 for x in seen["pii"].collect()) == sorted(i or 0 for i in kept)
    assert seen["pii"].filter("text like '%bob@%'").count() == 0
    assert all(x.n_chars == len(x.text) for x in seen["mixing"].collect() if x.text is not None)
    assert seen["sentencepiece"].count() == seen["mixing"].count() and seen["sentencepiece"].filter("not round_trip").count() == 0


def test_empty_tables(spark, tmp_path):
    _awkward(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert all(x.count() == 0 for x in _through(spark, tmp_path).values())


def test_no_labels_reject_nothing(spark, tmp_path):
    _awkward(spark, tmp_path, [(i, f"a b c {i}", None, None) for i in range(5)])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert _through(spark, tmp_path)["toxicity"].count() == 5
