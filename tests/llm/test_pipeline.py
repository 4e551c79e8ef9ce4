"""The corpus pipeline against its parts' brute-force versions."""

import re

import numpy as np

import corpus_pipeline
from ragframe.llm import packing, secrets
from ragframe.llm.common import saved, table

from .test_llm import brute_components, brute_spans

SF = "/root/testdata/sf0.001"


def test_edges(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns and an empty table, stage by stage."""
    long = " ".join(f"w{i % 977}" for i in range(20000))
    texts = [None, "", " ", "a b", "a  b", "a b", long, long + " z", "token = abcdefgh12345678 end of it all", None]
    columns = "doc_id long, text string, lang string, source string, n_chars long, fate string, __hash string, __spans string, n long, component_id long"
    rows = [(i if i != 9 else None, t, None, "s", len(t or ""), "x", "w", "y", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[3:4] + rows[6:7], columns).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for own in (docs, docs.limit(0)):
        kept = own
        for name, stage in corpus_pipeline.STAGES:
            kept = saved(stage(spark, kept, str(tmp_path)), name)
            got = kept.collect()
            if name != "packing":
                assert kept.columns == docs.columns
            if own is docs and name == "quality":
                assert len(got) == 12
            elif own is docs and name == "exact_dedup":
                assert sorted(r.doc_id for r in got) == [0, 2, 3, 6, 7, 8]
            elif own is docs and name == "near_dedup":
                assert sorted(r.doc_id for r in got) == [0, 2, 3, 6, 8] and next(r for r in got if r.doc_id == 0).text is None
            elif own is docs and name == "secrets":
                assert next(r for r in got if r.doc_id == 8).text == "[secret] end of it all"
            elif own is docs:
                assert {r.doc_id for r in got} == {0, 2, 3, 6, 8}
            else:
                assert not got


def test_secrets_stage_learns_from_all_texts(spark):
    """Identifiers of words that three texts each hold stay, whichever texts those are; a secret beside them goes."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(2500)]
    names = ["_".join(rng.choice(words, 4)) for _ in range(200)]
    hidden = "Zx9Qw3Lk7Vb2Nm5Tr8Yp4Hs6Jd1Gf0Ca"
    texts = [f"{words[i % 2500]} {i}" for i in range(7500)] + names + [f"a {hidden} z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_stage(spark, docs, SF).collect()}
    assert len(got) == len(texts) and got[7700] == "a [secret] z"
    changed = sum(got[7500 + i] != x for i, x in enumerate(names))
    print(f"identifiers of the corpus's words taken for secrets: {changed} of {len(names)}")
    assert changed <= 4


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    labels = table(spark, SF, "labels").toPandas()
    first = labels.assign(kept=labels.doc_id.isin(seen["quality"].doc_id))
    assert (first.kept == (first.quality == 1)).mean() > 0.95
    norm = seen["quality"].assign(key=[re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in seen["quality"].text])
    assert sorted(seen["exact_dedup"].doc_id) == sorted(norm.groupby("key").doc_id.min())
    rest = seen["exact_dedup"].sort_values("doc_id").reset_index(drop=True)
    roots, _ = brute_components(rest.text.tolist(), 5, 80)
    assert sorted(seen["near_dedup"].doc_id) == [rest.doc_id[i] for i in range(len(rest)) if roots[i] == i]
    assert sorted(seen["secrets"].doc_id) == sorted(seen["near_dedup"].doc_id)
    before = dict(zip(seen["near_dedup"].doc_id, seen["near_dedup"].text, strict=True))
    for r in seen["secrets"].itertuples():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) or secrets.ASSIGN and brute_spans(before[r.doc_id]) or "[secret]" in r.text
    sizes = seen["packing"].groupby("doc_id").length.sum()
    encode = packing.encoder(packing.default_tokenizer())
    assert all(sizes[r.doc_id] == len(encode(r.text)) + 1 for r in seen["secrets"].itertuples())
    assert (seen["packing"].groupby("sequence_id").length.sum() <= 1024).all() and np.isin(seen["packing"].doc_id, seen["secrets"].doc_id).all()
