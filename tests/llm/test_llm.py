"""Each operator against a brute-force version or the library itself, with nulls, empty, long, tied and repeated input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.shipping import ship

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, rejected string"


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def docs(sp, rows):
    """Documents with columns whose names clash with results."""
    return sp.createDataFrame([(i, t, lang, s, None, 1, "x") for i, t, lang, s in rows], SCHEMA).repartition(3)


def texts(sp, ts):
    return docs(sp, [(i, t, "en", "s") for i, t in enumerate(ts)])


def odd_texts(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", " ", "  ", "\n", "a ", None, "x" * 60_000, "word " * 20_000]


PARTS = ["a", "b", " ", "  ", "\t", "\n", "é", "'s", "<|endoftext|>", "the ", " The", "漢", "\xa0", "\r\n", "1", ".", "   ", "\x1c", "▁", "<s>", "Σ", "ß", "́"]
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def test_bpe_equals_the_library(sp):
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import decode, encode

    model = P.path("word_bpe_49k.json")
    t, ts = Tokenizer.from_file(model), odd_texts(1, 400, PARTS)
    df = texts(sp, ts)
    got = {r.doc_id: r for r in encode(df, model, digests=True).collect()}
    for i, x in enumerate(ts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), x
    twice = encode(df.filter("doc_id < 9").union(df.filter("doc_id < 9")), model, digests=True).collect()
    assert sorted(map(str, twice)) == sorted(str(got[i]) for i in range(9) for _ in range(2))  # repeated rows
    some = encode(df.filter("doc_id < 20"), model, carry=("source", "rank"))
    back = {r.doc_id: (r.text, r.source, r["rank"]) for r in decode(some, model).collect()}
    assert back[3] == (t.decode(t.encode(ts[3] or "", add_special_tokens=False).ids, skip_special_tokens=False), "s", 1)
    assert encode(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        encode(df, P.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(sp):
    import sentencepiece

    from tidemark.llm.token_counts import count_tokens

    model = P.path("piece_bpe_32k.model")
    m, ts = sentencepiece.SentencePieceProcessor(model_file=model), odd_texts(2, 400, PARTS)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(texts(sp, ts), model).collect()}
    for i, x in enumerate(ts):
        n = len(m.encode(x or ""))
        assert got[i] == (len((x or "").encode()), n, n > 4096), x
    df = texts(sp, ts).filter("doc_id < 9")
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df.union(df), model).collect()) == sorted((i, got[i][1]) for i in range(9) for _ in range(2))
    assert count_tokens(texts(sp, ["a"]).limit(0), model).count() == 0


def test_id_shards_equal_the_library(sp, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm.id_shards import Shard, id_documents

    model = P.path("byte_bpe_50k.json")
    t, ts = Tokenizer.from_file(model), odd_texts(3, 300, PARTS)
    df = texts(sp, ts)
    path = str(tmp_path / "shards")
    got = {r.doc_id: r for r in id_documents(df, model, path).collect()}
    at = 0
    want = []
    for i, x in enumerate(ts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), x
        at += len(ids)
        want.append(ids)
    rows = sp.read.parquet(path).collect()
    shard = next(r for r in rows if r.first_key <= 5 <= r.last_key)
    s = Shard(bytes(shard.payload), bytes(shard["index"]), shard.width)
    assert s.get(5).tolist() == want[5]
    with pytest.raises(KeyError):
        s.get(10**12)
    twice = docs(sp, [(1, "a b", "en", "s"), (1, "c", "en", "s"), (None, "n", "en", "s")])
    assert sorted((r.doc_id is None, r.start) for r in id_documents(twice, model).collect())[-1] == (True, 0)
    assert id_documents(df.limit(0), model).count() == 0


def test_id_shards_of_hot_keys_and_lookup(sp, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    from tidemark.llm import id_shards

    monkeypatch.setattr(id_shards, "SHARD_BYTES", 400)
    model, rng = P.path("byte_bpe_50k.json"), random.Random(6)
    t = Tokenizer.from_file(model)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    rows = [(rng.choice([None, None, 7, i]), " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(7, "same text"), (7, "same text"), (1000, "z" * 5000), (-5, None), (-5, "")]
    path = str(tmp_path / "hot")
    got = id_shards.id_documents(docs(sp, [(i, x, "en", "s") for i, x in rows]), model, path).collect()
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(np.array(ids(x), "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids(x)), crc(x)) for i, x in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-(2**63) if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    shards = sp.read.parquet(path)
    assert shards.filter("first_key = 7 AND last_key = 7").count() > 1  # a hot key has several shards, of bounded size
    assert max(len(r.payload) for r in shards.select("payload").collect() if len(r.payload) < 4000) < 800
    asked = sp.createDataFrame([(7,), (7,), (None,), (1000,), (-5,), (10**9,), (500,), (-6,)], "doc_id bigint")
    for spans in (1, 8, 1024):
        found: dict = {}
        for r in id_shards.lookup(shards, asked, spans=spans).orderBy("shard").collect():
            found[r.doc_id] = found.get(r.doc_id, []) + np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert set(found) == {7, None, 1000, -5} and found[1000] == ids("z" * 5000) and found[-5] == [2, 2]
        for k in (7, None):
            assert sorted(found[k]) == sorted(y for i, x in rows if i == k for y in ids(x))
    assert id_shards.lookup(shards, asked.limit(0)).count() == 0 and id_shards.lookup(shards.limit(0), asked).count() == 0


def test_perfect_hash_is_minimal():
    from tidemark.llm.id_shards import PerfectHash

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000)).astype(np.uint64)
    h = PerfectHash.load(PerfectHash.build(keys, np.arange(len(keys), dtype=np.uint64)[:, None]).dump())
    assert sorted(h.slot(keys)) == list(range(len(keys))) and (h.get(keys)[:, 0] == np.arange(len(keys))).all()


def brute_repeats(rows, n=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            least[b[i : i + n]] = min(d, least.get(b[i : i + n], d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < d:
                m[i : i + n] = b"\1" * n
        out[d] = (len(b), sum(m), sum(m[i] and not (i and m[i - 1]) for i in range(len(m))), sha(bytes(x for x, y in zip(b, m, strict=True) if not y)))
    return out


def test_suffix_dedup_against_all_windows(sp):
    from tidemark.llm.suffix_dedup import remove_repeats, without_repeats

    rng = random.Random(7)
    shared = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(40, 160))) for _ in range(12)]
    rows = []
    for i in range(150):
        t = ""
        for _ in range(rng.randint(0, 5)):
            p, c = rng.choice(shared), rng.random()
            a = rng.randint(0, len(p) // 2)
            t += p[a : a + rng.randint(20, 120)] if c < 0.4 else rng.choice(["ab ", "Des ", "a\0"]) * rng.randint(1, 60) if c < 0.6 else "".join(rng.choice("xyz w") for _ in range(rng.randint(1, 60)))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "long " * 8000), (203, "long " * 8000)]
    df = docs(sp, [(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, digests=True).collect()}
    assert got == brute_repeats(rows)
    out = without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert remove_repeats(df.limit(0), digests=True).count() == 0


def test_repeat_groups_hold_all_occurrences(sp):
    from tidemark.llm.suffix_dedup import LEAST, repeat_groups

    rng = random.Random(17)
    shared = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randint(50, 90))) for _ in range(6)]
    rows = []
    for i in range(80):
        rows.append((i, "".join(rng.choice([rng.choice(shared), "".join(rng.choice("xyz w") for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(0, 5)))))
    rows += [(90, None), (91, "")]
    text = {i: (t or "").encode() for i, t in rows}
    groups: dict = {}
    for r in repeat_groups(docs(sp, [(i, t, "en", "s") for i, t in rows])).collect():
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.at))
    covered = {i: bytearray(len(t)) for i, t in text.items()}
    for (_, n), places in groups.items():
        held = {text[i][a : a + n] for i, a in places}
        assert len(held) == 1 and n >= LEAST  # one string each
        s = held.pop()
        assert places == {(i, a) for i, t in text.items() for a in range(len(t) - n + 1) if t[a : a + n] == s}  # and every occurrence of it
        for i, a in places:
            covered[i][a : a + n] = b"\1" * n
    windows: dict = {}
    for i, t in text.items():
        for a in range(len(t) - LEAST + 1):
            windows.setdefault(t[a : a + LEAST], set()).add((i, a))
    for places in windows.values():
        if len({i for i, _ in places}) > 1:  # each string that two documents share lies in a repeat
            assert all(all(covered[i][a : a + LEAST]) for i, a in places)
    assert repeat_groups(docs(sp, [(1, "a", "en", "s")]).limit(0)).count() == 0


def test_interval_scan_against_all_pairs():
    from tidemark.llm.suffix_dedup import _scan

    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(2, 9)
        lcp, least = [rng.randint(50, 54) for _ in range(n - 1)], [rng.randint(0, 9) for _ in range(n)]
        want = set()
        for a in range(n):
            for b in range(a + 1, n):
                h = min(lcp[a:b])
                if (a == 0 or lcp[a - 1] < h) and (b == n - 1 or lcp[b] < h):
                    want.add((h, a, b, min(least[a : b + 1])))
        assert set(_scan(lcp, least, 0)) == want


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_fit_keeps_languages_of_few_long_texts(sp):
    from tidemark.llm.language_id import fit

    rng = random.Random(11)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, text("abcdef", 20), "aa", "s") for i in range(40)]
    for k, n in enumerate((2, 3, 6)):  # languages of few texts, each far longer than the sample
        rows += [(1000 + 10 * k + i, text("ghijklmnopqrstuvwxyz"[6 * k : 6 * k + 6], 6000), f"l{n}", "s") for i in range(n)]
    models = fit(docs(sp, rows), 2000)
    assert models.langs == ["aa", "l2", "l3", "l6"] and all(np.isfinite(x.middle) for x in models.limits)
    for k, n in enumerate((2, 3, 6)):
        assert models.predict([text("ghijklmnopqrstuvwxyz"[6 * k : 6 * k + 6], 30)])[0][0] == f"l{n}"


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)] + ["É", "AB"]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 10)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(x)))
    return [*rows, (900, ""), (901, None), (902, " \t"), (903, "same text " * 3000), (904, "same text " * 3000)]


def test_jaccard_components_against_all_pairs(sp):
    from tidemark.llm.near import keep_one_of_each, similarity_components

    rows = near_rows()
    df = docs(sp, [(i, t, "en", "s") for i, t in rows])
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_components(df).collect()} == want
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert similarity_components(df.limit(0)).count() == 0


def test_null_and_repeated_ids_remove_only_their_component(sp):
    from tidemark.llm.near import keep_one_of_each

    rng = random.Random(8)
    a, b, c, d, e, f, g = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(40)) for k in "abcdefg")
    rows = [(None, a), (None, b), (None, b + " more"), (None, ""), (None, None), (7, c), (7, d), (7, d), (7, ""), (7, ""), (7, "."), (3, d + " more"), (9, e), (None, e), (9, f + " more"), (9, f), (None, g), (None, g)]
    got = [(r.doc_id, r.text) for r in keep_one_of_each(docs(sp, [(i, x, "en", "s") for i, x in rows])).collect()]
    either = {b + " more": b, f + " more": f}  # one of the two, whichever
    want = [(None, a), (None, b), (None, ""), (None, None), (7, c), (7, ""), (7, "."), (3, d + " more"), (9, e), (9, f), (None, g)]
    assert sorted((str(i), str(either.get(x, x))) for i, x in got) == sorted((str(i), str(x)) for i, x in want)


def test_runs_and_many_buckets_like_whole(sp, monkeypatch):
    from tidemark.llm import near

    rows = near_rows()[:160]
    # every set of a root apart from most others, each comparison in a task of a few, more than LEAST_BUCKETS buckets
    for name, value in (("RUN_BYTES", 2000), ("SALT_ROWS", 3), ("BUCKET_BYTES", 100), ("BLOCK_BYTES", 3000), ("HOT_SHARE", 0.01)):
        monkeypatch.setattr(near, name, value)
    assert sum(len(t or "") + 1 for _, t in rows) // near.BUCKET_BYTES > near.LEAST_BUCKETS
    hot = [*rows, *((2000 + i, rows[3][1]) for i in range(200))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.similarity_components(docs(sp, [(i, t, "en", "s") for i, t in hot])).collect()]
    want = brute_components(hot)
    assert sorted(got) == sorted((d, *x) for d, x in want.items())


def test_merge_skip_against_counts():
    from tidemark.llm.near import merge_skip

    rng = random.Random(21)
    for _ in range(400):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        least = rng.randint(1, 6)
        counts = {x: sum(x in one for one in lists) for x in range(30)}
        assert merge_skip(lists, least) == [(x, n) for x, n in counts.items() if n >= least]


def test_search_against_all_pairs():
    from tidemark.llm.near import Search

    rng = random.Random(22)
    for _ in range(60):
        base = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(6)]
        sets = [np.unique(np.array([x if rng.random() > 0.07 else rng.randrange(200) for x in rng.choice(base)], dtype="<u8")) for _ in range(40)]
        comp = np.array([rng.choice([0, 0, 0, i]) for i in range(40)])
        asks = comp != 0
        links = Search(np.arange(40) + 100, sets, comp, asks, np.ones(40, bool), 80).links()
        similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert all(similar(sets[a - 100], sets[b - 100]) for a, b in links)

        def united(pairs):
            parent = list(range(40))

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a, b in pairs:
                parent[find(a)] = find(b)
            return [min(j for j in range(40) if find(j) == find(i)) for i in range(40)]

        known = [(i, j) for i in range(40) for j in range(i) if comp[i] == comp[j]]
        assert united(known + [(a - 100, b - 100) for a, b in links]) == united(known + [(i, j) for i in range(40) for j in range(i) if similar(sets[i], sets[j])])


def fill(sizes, weights, share, cap):
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_mix_meets_targets(sp):
    from tidemark.llm.mixing import mix, mixed_documents

    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(500)] + [(600, None, "en", "a"), (601, "", None, "b"), (601, "", None, "b"), (602, "x " * 5000, "en", "b")]
    df = docs(sp, rows)
    got = mix(df).collect()
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + [None]
    size = {n: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows if r[3] == n) for n in names}
    want = dict(zip(names, fill([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    for n in names:
        own = [r for r in got if r.source == n]
        assert {r.source_size for r in own} == {size[n]} and abs(own[0].target - want[n]) < 1e-6
        assert sum(r.taken for r in own) == round(want[n]) and all(0 <= r.taken <= 2 * r["size"] for r in own)
    for n in names:  # which rows: by unsigned key, whole epochs first, then up to the budget
        own = sorted((r for r in got if r.source == n), key=lambda r: r.key % 2**64)
        budget = round(want[n])
        epochs, rest = divmod(budget, size[n]) if size[n] else (0, 0)
        for r in own:
            assert r.taken == epochs * r["size"] + max(0, min(r["size"], rest))
            rest -= r["size"]
    assert sorted(map(str, mix(df.repartition(7)).collect())) == sorted(map(str, got)) and len(got) == len(rows)
    out = mixed_documents(df)
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == df.columns and all(copies.get(r.doc_id, 0) == -(-r.taken // r["size"]) for r in got if r["size"])
    assert mix(df.limit(0)).count() == 0


def test_mix_of_many_sources(sp):
    from tidemark.llm.mixing import mix

    rng = random.Random(19)
    rows = [(i, "w " * rng.randint(0, 9), "en", f"host{rng.randint(0, 299)}") for i in range(2000)]
    got = mix(docs(sp, rows)).collect()
    names = sorted({r[3] for r in rows})
    size = {n: sum(len(r[1].split()) for r in rows if r[3] == n) for n in names}
    want = dict(zip(names, fill([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_language_id(sp):
    from tidemark.llm.language_id import Models, identify, keep_identified

    rng = random.Random(2)
    parts = {"xx": ["the ", "an", "ing ", "er", "th"], "yy": ["ung ", "sch", "ei", "der ", "ü"], "zz": ["les ", "eau", "ê", "oi ", "qu"]}
    rows = [(i, "".join(rng.choice(parts[k]) for _ in range(rng.randint(5, 80))), k, "s") for i, k in enumerate(rng.choice(list(parts)) for _ in range(400))]
    rows += [(900, None, "xx", "s"), (901, "12 !!", "yy", "s"), (902, "", None, "s"), (903, "the an " * 9000, None, "s")]
    df = docs(sp, rows)
    got = {r.doc_id: r for r in identify(df).collect()}
    held = [i for i, *_ in rows[:400] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "xx"
    kept = keep_identified(df)
    assert kept.columns == df.columns and 395 <= kept.filter("doc_id < 900").count()
    assert kept.filter("doc_id IN (900, 901, 902)").count() == 0
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0
    m = Models.of_texts({"xx": [r[1] for r in rows[:400] if r[2] == "xx"]}).models[0]
    heads, back = m.backs[2]
    keys, prob = m.tables[2]
    assert np.all(np.diff(keys.astype(object)) > 0) and prob.max() <= 0 and back.max() <= 1e-6 and len(heads)


def slow_kneser_ney(train, text, order=4):
    """Cross-entropy per character, by dictionaries: interpolated, one discount an order, counts of continuations below the top."""
    from collections import Counter

    from tidemark.llm.language_id import ALPHABET

    def chars(t):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        return " " * (order - 1) + " ".join(words) + " "

    def grams(t):
        x = chars(t)
        return [x[i - order + 1 : i + 1] for i in range(order - 1, len(x))]

    counts = {order: Counter(g for t in train for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    less, total, kinds = {}, {}, {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        less[n] = once / (once + 2 * twice) if once else 0.5
        total[n], kinds[n] = Counter(), Counter()
        for g, v in c.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def prob(g):
        n = len(g)
        if not n:
            return 1 / ALPHABET
        rest = prob(g[1:])
        if not total[n][g[:-1]]:
            return rest
        return max(counts[n][g] - less[n], 0) / total[n][g[:-1]] + less[n] * kinds[n][g[:-1]] / total[n][g[:-1]] * rest

    own = grams(text)
    return -sum(np.log(prob(g)) for g in own) / len(own)


def test_language_models_equal_a_slow_kneser_ney(sp):
    from tidemark.llm.language_id import Models, fit

    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40)))
    train = {"aa": [text("abcé") for _ in range(30)], "bb": [text("abdß") for _ in range(20)]}
    asked = [text("abcé"), text("abdß"), text("xyz"), text("aXb"), "a", "Ab, c!"]
    h, n = Models.of_texts(train).entropies(asked)
    for i, t in enumerate(asked):
        for j, k in enumerate(("aa", "bb")):
            assert abs(h[i, j] - slow_kneser_ney(train[k], t)) < 1e-4, (t, k)
    # counted by executors: the same models as from the texts that the sample gives to fit
    rows = [(i, t, k, "s") for i, (k, t) in enumerate((k, t) for k, v in train.items() for t in v)]
    models, df = fit(docs(sp, rows + rows)), docs(sp, rows)
    import tidemark.llm.language_id as lid

    taken = lid._sample(df, lid.SAMPLE_BYTES, lid.TOTAL_BYTES).filter("NOT spare").collect()
    again = Models.of_texts({k: [r.text for r in taken if r.lang == k] for k in train})
    assert all((a.tables[n][0] == b.tables[n][0]).all() and np.allclose(a.tables[n][1], b.tables[n][1]) for a, b in zip(models.models, again.models, strict=True) for n in range(1, 5))


def test_foreign_texts_are_rejected_and_own_ones_kept(sp):
    from tidemark.llm.language_id import fit, predict

    rng = random.Random(12)
    words = {k: ["".join(rng.choice(c) for _ in range(rng.randint(2, 8))) for _ in range(400)] for k, c in {"aa": "abcdeilnorst", "bb": "äbdefghinrstu", "far": "бвгдежзик"}.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, text(k, rng.randint(1, 60)), k, "s") for i in range(300) for k in ("aa", "bb")]
    models = fit(docs(sp, rows))
    asked = [(i, text("far", 10 + i), None, "s") for i in range(20)] + [(100 + i, text(k, rng.randint(1, 60)), None, "s") for i, k in enumerate(["aa", "bb"] * 200)] + [(900, "qx " * 4000, None, "s")]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in predict(docs(sp, asked), models).collect()}
    assert all(got[i][1] for i in [*range(20), 900])
    assert sum(got[100 + i] == (("aa", "bb")[i % 2], False) for i in range(400)) >= 398


def test_fit_of_many_languages_and_one_repeated_text(sp):
    from tidemark.llm.language_id import fit

    rng = random.Random(13)
    rows = [(i, "same words again and again " * 40, "hot", "s") for i in range(400)] + [(400, "another text of it", "hot", "s")]
    rows += [(1000 + i, " ".join(chr(0x430 + i % 30) * rng.randint(1, 4) for _ in range(30)), f"l{i % 40}", "s") for i in range(400)]
    models = fit(docs(sp, rows), 2000, 41 * 1000)
    assert len(models.langs) == 41 and all(len(m.tables[4][0]) for m in models.models)
    assert models.predict(["same words again"])[0][0] == "hot" and np.isfinite(models.limits[models.langs.index("hot")].middle)
    with pytest.raises(ValueError, match="languages"):
        import tidemark.llm.language_id as lid

        keep, lid.MODEL_BYTES = lid.MODEL_BYTES, 1000
        try:
            fit(docs(sp, rows), 2000)
        finally:
            lid.MODEL_BYTES = keep


def test_hilbert_curve_and_shards(sp):
    from tidemark.llm.hilbert import hilbert_index, shard

    a, b = sp.range(8).select(F.col("id").alias("x")), sp.range(8).select(F.col("id").alias("y"))
    grid = a.join(b, F.lit(True)).select("x", "y", hilbert_index([F.col("x"), F.col("y")], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in grid] == list(range(64))
    assert all(abs(p.x - q.x) + abs(p.y - q.y) == 1 for p, q in zip(grid, grid[1:], strict=False))
    rng = random.Random(1)
    rows = [(i, "t" * rng.randint(0, 5000), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None])) for i in range(301)] + [(400, None, None, None), (401, "same", "en", "s1"), (401, "same", "en", "s1"), (402, "x" * 200_000, "en", "s1")]
    df = docs(sp, rows)
    got = shard(df).collect()
    per = {k: sorted(r.slot for r in got if r.shard == k) for k in range(8)}
    assert len(got) == len(rows) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(v == list(range(len(v))) for v in per.values())
    by = {r.doc_id: r for r in got}
    assert by[400]["size"] == 1 and by[400].text_crc32 == 0 and by[401].text_crc32 == zlib.crc32(b"same") and by[402]["size"] == 200_001
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert {str(r) for r in shard(df.repartition(7)).collect()} == {str(r) for r in got} and shard(df.limit(0)).count() == 0
    plan = shard(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Physical Plan")[-1])


def test_hilbert_keeps_equal_texts_together_and_tells_long_prefixes_apart(sp):
    from tidemark.llm.hilbert import _lines, shard

    rng = random.Random(2)
    rows = [(i, rng.choice([f"text {i % 9}", f"own {i}"]), "en", "s") for i in range(400)] + [(1000 + i, "hot", "en", "s") for i in range(200)]
    got = sorted(shard(docs(sp, rows)).collect(), key=lambda r: (r.shard, r.slot))
    places: dict = {}
    for n, r in enumerate(got):
        places.setdefault((r["size"], r.text_crc32, r.curve), []).append(n)
    assert all(v == list(range(v[0], v[0] + len(v))) for v in places.values()) and max(map(len, places.values())) >= 200
    hosts = docs(sp, [(i, "x", "en", f"https://host{i % 7}.example") for i in range(700)])
    lines = {r.value: r.line for r in _lines(hosts, "source", 5).collect()}
    assert len(lines) == 7 and len(set(lines.values())) == 7 and [lines[k] for k in sorted(lines)] == sorted(lines.values())
    assert all(1 <= x <= 31 for x in lines.values())


def test_hilbert_files_are_pruned(sp, tmp_path):
    from tidemark.llm.hilbert import files_for, write_shards

    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([5, 50, 500, 5000]), rng.choice(["de", "en", "fr", "it", None]), rng.choice("abcdefgh")) for i in range(2000)]
    path = str(tmp_path / "files")
    stats = write_shards(docs(sp, rows), path, shards=32)
    files = stats.count()
    assert files >= 32 and stats.agg(F.sum("rows")).first()[0] == 2000
    back = sp.read.parquet(path)
    assert sorted((r.doc_id, r.text, r.lang, r.source, r["rank"]) for r in back.select("doc_id", "text", "lang", "source", "rank").collect() if r.lang) == sorted((i, t, lang, s, 1) for i, t, lang, s in rows if lang)
    for want in ({"source": ("c", "c")}, {"source": ("c", "c"), "lang": ("fr", "fr")}, {"tm_size": (5001, 6000)}):
        names = {r.file for r in files_for(stats, **want).collect()}
        hit = back
        for c, (low, high) in want.items():
            hit = hit.filter(F.col(c).between(low, high))
        held = {r.file for r in hit.select(F.input_file_name().alias("file")).distinct().collect()}
        assert held and held <= names and len(names) <= 0.6 * files, (want, len(names), files)


def slow_adpcm(block):
    from tidemark.llm.telephony import CHANGES, STEPS

    x, i, out = int.from_bytes(block[:2], "little", signed=True), block[2], []
    out.append(x)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = STEPS[i]
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            x = max(-32768, min(32767, x - d if code & 8 else x + d))
            i = max(0, min(88, i + CHANGES[code & 7]))
            out.append(x)
    return out


def test_telephony_round_trip(sp, tmp_path):
    from tidemark.llm import telephony as t

    assert t.EXPAND[t.MULAW][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert t.EXPAND[t.ALAW][[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    ts = odd_texts(4, 60, PARTS) + ["same", "same"]
    path = str(tmp_path / "audio")
    got = {r.doc_id: r for r in t.audio_digests(texts(sp, ts), path).collect()}
    stored = {r.doc_id: r for r in sp.read.parquet(path).collect()}
    seen = set()
    for i, x in enumerate(ts):
        raw = (x or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        tag = (t.MULAW, t.ALAW, t.ADPCM)[zlib.crc32(payload) % 3]
        wave = t.write_wave(payload, tag)
        assert (r.media_bytes, r.media_sha256) == (len(wave), sha(wave))
        found, data = t.read_wave(wave)
        assert found == tag and t.payload_of(found, data) == payload
        assert bytes(stored[i].media) == wave
        pcm = t.unpack_pcm([bytes(stored[i].pcm)])[0]
        assert len(stored[i].pcm) == 1 + len(pcm)
        assert f"n={len(pcm)};peak={abs(pcm.astype(int)).max()};" in r.feature
        if tag == t.ADPCM and len(payload) < 2000:
            assert pcm[0::2].tolist() == [y for block in data for y in slow_adpcm(block.tolist())]
        elif tag != t.ADPCM:
            assert (pcm[0::2] == t.EXPAND[tag][data]).all()
        assert r.feature.startswith(t.NAMES[tag])
        seen.add(tag)
    a, b = got[len(ts) - 2].asDict(), got[len(ts) - 1].asDict()
    assert {k: v for k, v in a.items() if k != "doc_id"} == {k: v for k, v in b.items() if k != "doc_id"} and len(seen) == 3
    with pytest.raises(ValueError):
        t.read_wave(b"RIFFxxxxWAVE")
    assert t.audio_digests(texts(sp, ["a"]).limit(0)).count() == 0


def test_stored_pcm_is_lossless():
    from tidemark.llm.telephony import pack_pcm, unpack_pcm

    rng = np.random.default_rng(9)
    signals = [rng.integers(-32768, 32768, 2 * n).astype("<i2") for n in (1, 2, 50, 7)] + [np.repeat(np.int16([-32768, 32767, 0]), 4)]
    for smooth in ([False] * 5, [True] * 5, [True, False, True, False, True]):
        assert all((a == b).all() for a, b in zip(unpack_pcm(pack_pcm(signals, smooth)), signals, strict=True))


def test_top_k_against_all_products(sp):
    from tidemark.llm.knn import top_k

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [(2000, None), (2050, [1.0, None, *[0.0] * 6]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2201, [3.0, 4.0]), (None, [1.0] * 8), (2300, [1e9] * 8), (100, rows[100][1]), (2400, [1e7, 1.0, *[0.0] * 6]), (2450, [1e7, 2.0, *[0.0] * 6]), (2500, [1e300] * 8), (2550, [-1e300, *[0.0] * 7]), (2600, [-0.0] * 8)]
    df = sp.createDataFrame([(i, v, 5) for i, v in rows], "vec_id bigint, embedding array<double>, rank int").repartition(3)
    ok = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    near = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = set()
    for q, a in ok.items():
        if q % 50 == 0:
            best = sorted((-near(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in ok.items() if i != q and len(a) == len(b))[:5]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in top_k(df, pivots=6).collect()} == want
    assert top_k(df.limit(0)).count() == 0


def test_top_k_in_chunks_and_blocks(sp, monkeypatch):
    from tidemark.llm import knn

    monkeypatch.setattr(knn, "CHUNK_ROWS", 20)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    df = sp.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(500)], "vec_id bigint, embedding array<double>")
    a = {tuple(r) for r in knn.top_k(df, pivots=3).collect()}
    monkeypatch.undo()
    assert a == {tuple(r) for r in knn.top_k(df, pivots=3).collect()} and len(a) == 50


def test_top_k_writes_nothing_for_a_pair(sp):
    """Vectors without structure, of which every cell is wanted by every query: files stay below twice the vectors' doubles."""
    import pathlib

    from tidemark.llm.knn import top_k

    folder = pathlib.Path(sp.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tidemark"
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 16))
    df = sp.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(2)
    there = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = there()
    got = {tuple(r) for r in top_k(df, every=2, pivots=500).collect()}
    assert there() - before < 2 * x.nbytes
    y = np.floor(256 * x).astype(np.int64)
    score = y @ y.T
    want = {(q, n, i, -s) for q in range(0, 4000, 2) for n, (s, i) in enumerate(sorted((-int(score[q, i]), i) for i in np.argsort(-score[q])[:40].tolist() if i != q)[:5], 1)}
    assert got == want


def test_top_k_of_equal_queries(sp):
    """Equal vectors are one query; with every row asked none of their ids is lost."""
    from tidemark.llm.knn import top_k

    df = sp.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(40)], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(df, k=2, every=1).collect())
    assert [r[:3] for r in got] == [(q, n, i) for q in range(40) for n, i in enumerate([i for i in (range(1, 40, 2) if q % 2 else range(40)) if i != q][:2], 1)]


def test_components_of_chains(sp):
    from tidemark.llm.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(sp.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100
