"""The stages of the corpus pipeline, each against a plain version on its own input, and the chain of them."""

import random

import pytest

from tests.llm.test_llm import SCHEMA, brute_components, brute_repeats, sha, shingles

P = pytest.importorskip("public_tokenizers")
WORDS = {"aa": "abcdeilnorst", "bb": "äbdefghinrstu"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    words = {k: ["".join(rng.choice(c) for _ in range(rng.randint(2, 9))) for _ in range(600)] for k, c in WORDS.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    passage = text("aa", 60)
    rows = [(i, text(k, rng.randint(20, 120)), k, rng.choice(["s1", "s2", None])) for i, k in enumerate(rng.choice(["aa", "bb"]) for _ in range(120))]
    rows += [(200 + i, rows[i % 4][1], rows[i % 4][2], "s1") for i in range(40)]  # exact copies
    rows += [(300 + i, rows[5][1] + f" tail{i}", rows[5][2], "s2") for i in range(12)]  # near copies
    rows += [(400 + i, text("aa", 30) + " " + passage + " " + text("aa", 20), "aa", "s3") for i in range(6)]
    rows += [(500, None, "aa", "s1"), (501, "", "bb", "s1"), (502, "12 34 !!", "aa", "s2"), (None, text("bb", 40), "bb", None), (None, text("aa", 50), "aa", "s1"), (503, text("aa", 9000), "aa", "s2")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, lang, s, None, 1, "x") for i, t, lang, s in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_each_stage_against_a_plain_version(spark, corpus):
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline
    from tidemark.llm.mixing import mix
    from tidemark.llm.shared import table

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "mixture", "token_ids"]
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = table(stage(spark, docs, corpus), name)
        after = out.collect()
        if name != "token_ids":
            assert out.columns == docs.columns
        if name == "language_id":  # all but the three without letters
            assert sorted(str(r.doc_id) for r in after) == sorted(str(i) for i, t, _ in before if i not in (500, 501, 502))
        if name == "near_duplicates":
            known = [(i, t) for i, t, _ in before if i is not None]
            want = {str(c) for _, c in brute_components(known).values()}
            assert {str(r.doc_id) for r in after} == want | {"None"} and len(after) == len(want) + 2
            assert all(shingles(r.text) for r in after)
        if name == "repeated_passages":
            known = [(i, t) for i, t, _ in before if i is not None]
            least = [(-2 + n, t) for n, (i, t, _) in enumerate(b for b in before if b[0] is None)]
            want = {d: kept for d, (*_, kept) in brute_repeats([*least, *known]).items()}
            assert all(sha(r.text.encode()) == want[r.doc_id] for r in after if r.doc_id is not None) and len(after) == len(before)
        if name == "mixture":
            takes = [(r.doc_id, r["size"], r.taken) for r in mix(docs).collect()]
            copies = sorted(str(i) for i, n, taken in takes for _ in range(-(-taken // n) if n else 0))
            assert sorted(str(r.doc_id) for r in after) == copies
        if name == "token_ids":
            t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            want = []
            for i, text, source in before:
                ids = t.encode(text or "", add_special_tokens=False).ids
                want.append(str((i, source, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))))
            assert sorted(str((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in after) == sorted(want)
        docs = out
    assert docs.count() > 100


def test_the_chain_of_an_empty_table(spark, corpus, tmp_path):
    import corpus_pipeline as pipeline

    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
