"""The training-data operators on nulls, empty and odd texts, ties, repeated rows, empty tables and extra columns,
against brute force."""

import hashlib
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, buckets, decontam, exact_dedup, html_main, ngram_join, packing, pii, quality, queries, token_cache, toxicity
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.runtime import bit_filter, drop_rows, filter_hits, least_hashed, spread

LONG = "word " * 20_000
ODD = [None, "", " ", "\n\t", "a", "Plain text, it's here.", "Ünï çödé 日本 😀", "<|endoftext|> x", LONG, "x" * 3000, "A a\x1c b　c", "  two  spaces  ", "▁ mark"]
EXTRA = "doc_id long, text string, digest string, n int, ids int, words int, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "d", 1, 2, 3, "en", "s", len(t or "")) for i, t in enumerate(texts, start)], EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.decode(bpe.encode(docs(spark, ODD), path), path).collect():
        ids = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(empty(spark), path).count() == 0


def test_bpe_of_white_space_and_odd_files():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, table, rng = Tokenizer.from_file(path), bpe.load(path), random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice([" ", " ", "  ", "\n", "\t", "\u3000", "\x1c", "a", "it's", "'ll", "9", "é日", "!?", "word"]) for _ in range(rng.randint(0, 14)))
        assert table.encode(t) == library.encode(t, add_special_tokens=False).ids, t
    spec = json.load(open(path))
    bpe.ByteBpe._assert_plain(spec)
    for odd in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.ByteBpe._assert_plain(spec | odd)


def test_bpe_cuts_are_certain_and_both_merge_loops_agree():
    table = bpe.load(tokenizer_path("byte_bpe_50k.json"))
    plain = bpe.ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    plain.compiled = None
    rng = random.Random(1)
    for _ in range(300):
        word = bytes(rng.choice(b"aeths \xc3\xa9\xe6") for _ in range(rng.randint(1, 90)))
        assert plain.merge(word) == table.merge(word) == [i for f in table.fragments(word) for i in plain.merge(f)]


def test_bpe_merges_a_word_once_whatever_mark_follows(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, table, merged = Tokenizer.from_file(path), bpe.ByteBpe(path), []
    compiled = table.compiled
    monkeypatch.setattr(table, "compiled", lambda f: merged.append(f) or compiled(f))
    for word in ("thonreandin", "Geländejq", "日本語", "ǅʰ"):
        for mark in ("", *".,;:!?"):
            for t in (f"x {word}{mark}", f"x {word}{mark} y"):
                assert table.encode(t) == library.encode(t, add_special_tokens=False).ids, t
    whole = [f for f in table.fragments(b" thonreandin") if len(f) > 1]
    assert whole and [merged.count(f) for f in whole] == [1] * len(whole)


def test_packing_is_lossless_and_best_fit(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(100) for _ in range(rng.choice([0, 1, 5, 16, 17, 70]))]) for i in range(60)] + [(60, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1), 16).collect()
    back = {}
    for r in got:
        assert len(r["ids"]) <= 16 and r["cu_seqlens"][-1] == len(r["ids"])
        for k, (d, o) in enumerate(zip(r["doc_ids"], r["offsets"])):
            a, b = r["cu_seqlens"][k : k + 2]
            assert r["positions"][a:b] == list(range(b - a))
            back.setdefault(d, {})[o] = r["ids"][a:b]
    assert {d: [x for o in sorted(p) for x in p[o]] for d, p in back.items()} == {d: ids for d, ids in rows if ids}
    for _ in range(50):
        sizes, room = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))], []
        for s in sorted(sizes, reverse=True):  # plain best fit decreasing
            fit = [k for k, x in enumerate(room) if x >= s]
            k = min(fit, key=lambda k: room[k]) if fit else len(room)
            room = room + [20] if not fit else room
            room[k] -= s
        assert sorted(20 - sum(sizes[i] for i in row) for row in packing.best_fit(sizes, 20)) == sorted(room)
    assert packing.pack(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


def test_packing_query_writes_token_ids(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [*ODD, "a", "a"]
    docs(spark, texts).union(docs(spark, ["again"], 3).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "new_folder", lambda *_: str(tmp_path / "packed"))
    shown = {r["pack_id"]: r for r in queries.op2_packing(spark, str(tmp_path)).collect()}
    back = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        assert len(r["matrix_row"]) == 4 * 8192
        row, n = np.frombuffer(r["matrix_row"], "<i4"), r["cu_seqlens"][-1]
        assert not row[n:].any()
        assert r["position_resets"] == (r["cu_seqlens"] if n < 8192 else r["cu_seqlens"][:-1])
        own = shown.pop(r["pack_id"])
        assert own["n_tokens"] == n and own["ids_sha256"] == hashlib.sha256(row[:n].tobytes()).hexdigest() and own["n_resets"] == len(r["position_resets"])
        for k, (d, o) in enumerate(zip(r["doc_ids"], r["offsets"])):
            back.setdefault(d, {})[o] = row[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
    assert not shown
    end = library.token_to_id("<|endoftext|>")
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, end] for i, t in [*enumerate(texts), (None, "again")]}
    assert {d: [x for o in sorted(p) for x in p[o]] for d, p in back.items()} == want
    assert packing.matrix(empty(spark), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_dedup(spark):
    texts = ["A", "a", None, "", "É", "é", "b", "a"]
    df = docs(spark, texts).union(docs(spark, ["b"], 6))  # a repeated row
    got = exact_dedup.deduplicate(df).collect()
    want = {}
    for i, t in [*enumerate(texts), (6, "b")]:
        want.setdefault(fold(t), []).append(i)
    assert len(got) == 9
    for r in got:
        own = want[fold(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(fold(texts[r["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.deduplicate(empty(spark)).count() == 0
    assert {r["keep_id"] for r in exact_dedup.deduplicate(docs(spark, ["x", "x"]), keep="smallest").collect()} == {0}


def test_dedup_index_of_many_runs(spark, tmp_path):
    rows = docs(spark, [f"t{k % 50}" for k in range(400)]).repartition(4)
    for part in rows.randomSplit([1.0, 1.0], 3):  # two flushes
        exact_dedup.flush(exact_dedup.entries(part), str(tmp_path / "l0"))
    assert len(list((tmp_path / "l0").glob("part-*"))) >= 4
    index = exact_dedup.compact(spark, str(tmp_path / "l0"), str(tmp_path / "l1"))
    digest = hashlib.sha256(b"t7").digest()
    assert [(r["least_id"], r["most_id"], r["n"]) for r in exact_dedup.lookup(index, [digest]).collect()] == [(7, 357, 8)]
    assert index.count() == 50


def test_dedup_verifies_bytes_and_null_identifiers(spark, monkeypatch):
    # a digest that takes texts of equal length for equal
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.md5(F.length(c).cast("string")))
    got = exact_dedup.deduplicate(docs(spark, ["aa", "bb", "AA", "c", "bb"])).collect()
    monkeypatch.undo()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(0, 2, 2), (1, 4, 2), (2, 2, 2), (3, 3, 1), (4, 4, 2)]
    odd = docs(spark, ["x", "x", "y"]).withColumn("doc_id", F.expr("if(doc_id = 1, 1, null)").cast("long"))
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(odd).collect()), key=str)
    assert got == [(1, 1, 2, True), (None, 1, 2, False), (None, None, 1, True)]
    assert {r["group_size"] for r in exact_dedup.deduplicate(docs(spark, [LONG * 10, LONG.upper() * 10])).collect()} == {2}


def test_token_counts_and_cache(spark, tmp_path):
    import sentencepiece

    path, cache = tokenizer_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(2):  # the second time all counts come from the cache
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_cache.token_counts(docs(spark, [*ODD, "a"]), path, cache).collect()}
        for i, t in enumerate([*ODD, "a"]):
            n = len(model.encode(t or ""))
            assert got[i] == (len((t or "").encode()), n, n > 4096)
        assert spark.read.parquet(cache).count() == len({t or "" for t in ODD})
    assert token_cache.token_counts(empty(spark), path, cache).count() == 0


def test_token_cache_stores_a_digest_once(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    token_cache.token_counts(docs(spark, ["a", "b b"]), path, cache).count()
    # as if all rows passed the bit filter by chance
    monkeypatch.setattr(token_cache, "filter_hits", lambda df, bits, keys, out: df.withColumn(out, F.lit(True)))
    got = token_cache.token_counts(docs(spark, ["a", "b b", "c c c", "a"]), path, cache)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3]
    assert spark.read.parquet(cache).count() == 3


def test_token_cache_of_concurrent_runs_and_null_identifiers(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_path("piece_bpe_32k.model"), str(tmp_path / "cache")
    token_cache.token_counts(docs(spark, ["a", "b b"]), path, cache).count()
    spark.read.parquet(cache).write.mode("append").parquet(cache)  # another run has appended the same
    nameless = docs(spark, ["a", "c c"]).withColumn("doc_id", F.lit(None).cast("long"))
    got = token_cache.token_counts(docs(spark, ["a", "b b"]).union(nameless).union(nameless), path, cache).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("0", 1), ("1", 2), ("None", 1), ("None", 1), ("None", 2), ("None", 2)]
    size = spark.read.parquet(cache).count()
    docs(spark, ["a", "c c"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(token_cache.CACHE_CONF, cache)
    try:
        assert sorted(r["n_tokens"] for r in queries.op8_token_counts(spark, str(tmp_path)).collect()) == [1, 2]
    finally:
        spark.conf.unset(token_cache.CACHE_CONF)
    assert spark.read.parquet(cache).count() == size  # all came from the cache


def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = [x for x in re.split("[\x20\x09-\x0d]+", fold(t)) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_shipped_prefixes_of_linked_sets_have_enough_in_common():
    rng = np.random.default_rng(5)
    for percent in (20, 50, 75, 100):
        for _ in range(1500):
            a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64))
            kept = a[rng.random(len(a)) < rng.choice([0.8, 0.9, 1.0])]
            b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(a) // 4)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < percent * (len(a) + len(b) - common):
                continue
            (x, least), (y, most) = (ngram_join._prefix(s, percent) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= max(least, most)


@pytest.mark.parametrize("least", [2, 3])
def test_shared_hashes_are_found_whatever_the_chunks(least):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 40)).astype(np.uint64) << np.uint64(20)) + np.uint64(k % 4) for k in range(40)]
    every, times = np.unique(np.concatenate(sets), return_counts=True)
    want = {(k + 1, int(x)) for k, s in enumerate(sets) for x in buckets.keys_of(s[np.isin(s, every[times >= least])], 4)}
    for chunk in (1, 7, 40):
        rows = {}
        for i in range(0, len(sets), chunk):
            for bucket, *row in buckets.shipped(sets[i : i + chunk], list(range(i + 1, min(i + chunk, 40) + 1)), 4, least):
                rows.setdefault(bucket, []).append(row)
        got = {(int(r), int(k)) for b, parts in rows.items() for r, k in zip(*buckets.shared(parts, b, least))}
        assert got == want


def test_matchable_postings_and_no_minimum_over_a_join(spark, monkeypatch):
    plans, write = {}, ngram_join.materialize

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(ngram_join, "materialize", noted)
    rng = random.Random(9)
    # hash 0 is hot: of 300 components; hash 1 of one only
    rows = [(t, r, c, n, rng.randint(1, n)) for r, (t, c) in enumerate([(0, k) for k in range(300)] + [(1, 7)] * 5 + [(rng.randint(2, 30), rng.randint(0, 9)) for _ in range(300)]) for n in [rng.randint(4, 40)]]
    got = ngram_join._matchable(spark.createDataFrame(rows, "token long, ref long, comp long, n int, rest int"), 75).collect()
    want = set()
    for t, r, c, n, rest in rows:
        other = [x for x in rows if x[0] == t and x[2] != c]
        if other and 175 * min(rest, max(x[4] for x in other)) >= 75 * (n + min(x[3] for x in other)):
            want.add(r)
    assert want and len(got) == len(want) and {r["ref"] for r in got} == want
    # a join whose rows are aggregated by its own key without being written first cannot be split
    assert "Aggregate" in plans["join-extremes"] and "Join" not in plans["join-extremes"]


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120]))] for _ in range(8)]
    texts = [None, "", " ", "one", "ONE", "a b c d e", "A b c d e"]
    for words in base:
        for _ in range(12):  # chains of copies, some of them linked only through others
            words = [rng.choice(vocabulary) if rng.random() < 0.012 else w for w in words]
            texts.append(" ".join(words))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)
    odd = docs(spark, [None, "", "one", LONG, LONG + "x y"]).union(docs(spark, ["one", LONG]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd.union(odd)).collect()), key=str)
    # "word word word word word" is one n-gram; with "x y" there are three, of which two are its own
    assert got == sorted(2 * [(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 1, 3), (4, 3, 4), (None, 1, 2), (None, 1, 3)], key=str)
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])  # both joins
def test_decontamination(spark, limit):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(60)}"
    items = [" ".join(word() for _ in range(n)) for n in (30, 12, 10, 10, 5, 4, 1)] + ["same " * 14, None, "", "!!"]
    texts = [None, "", "!!", "Same same " * 9]
    for k, item in enumerate(items[:7]):
        own = item.split()
        texts += [f"x {item.upper()} y, {item}", " ".join(own[: max(1, len(own) - 1)]), " ".join(word() for _ in range(80))]
    texts.append(nameless := "null item words that are hit but not named by anybody")
    rows = spark.createDataFrame([*enumerate(items), (None, nameless)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs(spark, texts), rows, broadcast_bytes=limit).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    for i, t in enumerate(texts):
        own, hit, names = split(t), set(), set()
        for k, item in [*enumerate(items), (None, nameless)]:
            w = split(item)
            for j in range(max(1, len(w) - 9) if w else 0):
                window = w[j : j + 10]
                for at in range(len(own) - len(window) + 1):
                    if own[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        names.update({str(k)} - {"None"})
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) == (len(own), len(hit), sorted(names)), t
    assert len(got) == len(texts)
    none = decontam.decontaminate(docs(spark, ["a", "a"]).union(docs(spark, ["a"])), rows.limit(0), broadcast_bytes=limit)
    assert sorted((r["doc_id"], r["n_words"], r["contaminated"]) for r in none.collect()) == [(0, 1, False), (0, 1, False), (1, 1, False)]
    assert decontam.decontaminate(empty(spark), rows, broadcast_bytes=limit).count() == 0
    # a text that repeats one word, a long one that is all benchmark, and repeated rows without an identifier
    whole = " ".join(f"b{k}" for k in range(30_000))
    rows = spark.createDataFrame([(1, "word " * 30), (2, whole)], "item_id long, text string")
    long = docs(spark, ["word " * 20_000, whole, "word " * 9]).union(docs(spark, ["word " * 10] * 2).withColumn("doc_id", F.lit(None).cast("long")))
    got = decontam.decontaminate(long, rows, broadcast_bytes=limit).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == [(0, 20_000, 20_000, ["1"]), (1, 30_000, 30_000, ["2"]), (2, 9, 0, []), (None, 10, 10, ["1"]), (None, 10, 10, ["1"])]


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0
    return True


def test_personal_data(spark):
    texts = [None, "", "a@b.c_d@e.f@g.h.i, x@y", "😀 mail me: jo.e+1@ex-a.co.uk!", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (523) 555-1055, +12 3", "9" * 20_000, "a" * 20_000 + "@b.cc", "card 4111111111111111", "call 523-555-1055 now", "jo (at) ex (dot) com", "jo (at) ex" + ".a" * 30_000, "x@y" + ".a" * 30_000, "+1" + " 2" * 30_000, "1.2.3.4 " * 3000]
    rng = random.Random(5)
    texts += ["".join(rng.choice("a1.@+- ()é4") for _ in range(60)) for _ in range(200)]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, texts)).select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans")).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, t or "") if valid(kind, m[0]))
        want = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found)
        assert got[i]["base"] == want, t
        assert set(want.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert got[11]["spans"] == "email:0:20" and got[12]["spans"] == f"email:0:{10 + 60_000}"
    assert pii.personal_data(empty(spark)).count() == 0
    odd = docs(spark, ["a@b.c", "a@b.c"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["spans"] for r in pii.personal_data(odd).select(pii.listed("spans").alias("spans")).collect()] == ["email:0:5"] * 2


def test_html(spark):
    page = "<head><title>T</title></head><nav>menu</nav><article><header><h1>H &amp; X</h1></header><p>a<b>b</b>\n c<p>d&nbsp;e<div class='comments'>no</div><script>if (a < b) {}</script></article><aside>s</aside>"
    loose = [f"<div>Welcome to our site please read the rules first</div><p>{k} own words of page {k}" for k in range(4)]
    rows = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "http://h/3", "")] + [(10 + k, "http://l/x", h) for k, h in enumerate(loose)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.extract(rows).collect()}
    assert got[1] == "H & X ab c d e" and got[2] == got[3] == ""
    assert [got[10 + k] for k in range(4)] == [f"{k} own words of page {k}" for k in range(4)]
    assert html_main.extract(rows.limit(0)).count() == 0


def test_html_counts_the_whole_host(spark):
    notice = lambda k: " ".join(f"notice{k}word{i}" for i in range(9))
    page = lambda i: " ".join(f"own{i}word{k}" for k in range(10))
    # each notice of the first 20 stands on 3 of 600 pages, the others on 2 contents only
    of = lambda i: i % 200 if i % 200 < 20 else 20 + i % 200 if i < 400 else None
    rows = [(i, "http://big/", (f"<div>{notice(of(i))}</div>" if of(i) is not None else "") + f"<p>{page(i)}") for i in range(600)]
    rows += [(i + 1000, "http://big/", rows[i][2]) for i in (30, 31)]  # copies are of the same content
    got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 602
    for i, text in got.items():
        k = of(i % 1000)
        assert text == (page(i % 1000) if k is None or k < 20 else f"{notice(k)} {page(i % 1000)}"), i


def test_html_examines_all_blocks(spark):
    words = lambda name, n=12: " ".join(f"{name}w{i}" for i in range(n))
    rows = []
    for i in range(4):
        body = "".join(f"<p>{words(f'own{i}p{k}')}" for k in range(6))
        # the body stands outside a teaser's article; a notice is repeated outside of it
        rows.append((i, "http://a/", f"<article><h2>{words(f'teaser{i}', 3)}</h2></article><div>{body}</div><div>{words('notice')}</div>"))
        # an unmarked notice, a quotation, a heading, and a quoted part of a paragraph inside an article
        rows.append((10 + i, "http://b/", f"<article><h1>{words('head')}</h1>{body}<p>{words('notice')}</p><p>x{i} {words('part')} y{i}</p><blockquote>{words('quote')}</blockquote></article>"))
        # near copies
        rows.append((20 + i, "http://c/", f"<article><p>{words('same', 40)}</p><p>z{i}</p></article>"))
    got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        body = " ".join(words(f"own{i}p{k}") for k in range(6))
        assert got[i] == f"{words(f'teaser{i}', 3)} {body}"
        assert got[10 + i] == f"{words('head')} {body} x{i} {words('part')} y{i} {words('quote')}"
        assert got[20 + i] == f"{words('same', 40)} z{i}"


def test_html_of_bad_markup(spark):
    cases = {
        "<article><p title=it's>Hello, don't drop me</p><p>Tail text.</p></article>": "Hello, don't drop me Tail text.",
        "<article><h1 class='post-header'>Head</h1><section class=related-work>Work</section><div class='comments-area'>no</div><div class=ad-box>no</div></article>": "Head Work",
        "<p>1 < 2 and <3 <b>x</b> <": "1 < 2 and <3 x <",
        "a<!-- no": "a",
        "a<!doctype": "a",
        "a <b title='x>y": "a y",
        "<div><select><p>in</div>out": "in out",
        "a<script>no</script >b": "a b",
    }
    for html, want in cases.items():
        assert " ".join(t for _, t in html_main.blocks(html)) == want, html
    for bad in ("<a ", "<a x='", "<a x=\"'>", "<div></p>", "</p><div>", "<select>", "<!-", "<![", "<x <", "<p x==", "&am"):
        start = time.process_time()
        html_main.blocks(bad * 100_000)
        assert time.process_time() - start < 5, bad  # a quadratic scan would take hours
    rows = [(1, "http://h/", "word " * 200_000), (1, "http://h/", "word " * 200_000), (None, None, "x"), (None, None, "x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, content int")
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in html_main.extract(df).collect()))
    assert got == [(0, 1), (0, 1), (1, 999_999), (1, 999_999)]


def test_html_of_marked_paragraphs_left_out_ends_and_split_references(spark):
    cases = {
        "<article><p class='ad'>Buy <b>now</p><p>keep</p></article>": "keep",
        "<p id=cookie-notice>We use cookies <a>x<p>keep": "keep",
        "<article><p class=advert>Buy<div>keep</div><p class=ad>no</article>tail": "keep tail",
        "<article><ul><li class=ad>no<li>yes<ul><li class=ad>no</ul>more</ul></article>": "yes more",
        "<table><tr><td class=sidebar>menu<td>body<tr><td>next</table>": "body next",
        "<article>a &am<b>p;</b> &lt<!-- -->; &amp;lt; &#65;<i>&#x42;</i></article>": "a &amp; <; &lt; AB",
    }
    rows = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.extract(rows).collect()}
    assert got == dict(enumerate(cases.values()))
    for bad in ("<p class=ad>", "<p class=ad><b>", "<li>", "<li><b>", "<td><p class=ad><tr>", "<div><p class=ad>"):
        start = time.process_time()
        html_main.blocks(bad * 100_000)
        assert time.process_time() - start < 5, bad


def labelled(spark):
    rng = random.Random(6)
    calm, bad = [f"calm{i}" for i in range(80)], ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [rng.choice(calm) for _ in range(40)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        poor = i % 5 == 0
        rows.append((i, ("!! " if poor else " ").join(w.upper() if poor else w for w in words), "en", "s", 300))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    got = toxicity.toxicity(rows, labels).join(labels, "doc_id").where("held_out").collect()
    assert got and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    relabelled = toxicity.toxicity(rows, labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1).otherwise(F.col("toxic"))))
    assert sorted(map(tuple, relabelled.collect())) == sorted(map(tuple, toxicity.toxicity(rows, labels).collect()))  # held-out labels change nothing
    odd = docs(spark, ODD)
    assert toxicity.toxicity(odd, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(odd.union(odd), labels).count() == 2 * len(ODD)


def test_quality(spark):
    rows, labels = labelled(spark)
    some = labels.where("doc_id < 400")
    got = quality.quality(rows, some).join(labels.select("doc_id", "quality"), "doc_id").where("doc_id >= 400").collect()
    assert np.mean([r["quality_kept"] == (r["quality"] == 1) for r in got]) > 0.95
    same = quality.quality(rows.withColumn("quality_kept", F.lit("old")), some)
    assert same.count() == 600 and same.schema["quality_kept"].dataType.simpleString() == "boolean"
    odd = docs(spark, ODD).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    assert quality.quality(odd, some).count() == len(ODD)
    assert quality.quality(odd, some.limit(0)).where("not quality_kept").count() == 0
    assert quality.quality(empty(spark), some).count() == 0


def test_threshold_needs_no_negatives():
    rng = np.random.default_rng(8)
    positive = rng.normal(4, 1, 300)
    unlabelled = np.concatenate([rng.normal(-4, 1, 950), rng.normal(4, 1, 50)])
    t = toxicity.threshold(positive, unlabelled)
    assert (positive > t).mean() > 0.97 and (unlabelled[:950] > t).mean() < 0.01
    assert toxicity.threshold(positive[:0], unlabelled) == 0


def test_rows_of_least_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    want = [r["k"] for r in df.orderBy(spread(F.col("k")), "k").limit(50).collect()]
    assert [r["k"] for r in least_hashed(df, "k", 50, 5000).collect()] == want
    assert least_hashed(df, "k", 50, 0).count() == 50 and least_hashed(df.limit(9), "k", 50, 9).count() == 9


def test_bit_filter_and_row_drop(spark):
    rows = spark.range(2000).withColumnRenamed("id", "k")
    own = rows.where("k % 7 = 0")
    marked = filter_hits(rows, bit_filter(own, "k"), [F.col("k")], "hit")
    assert marked.where("k % 7 = 0 and not hit").count() == 0 and marked.where("hit").count() < 400
    assert sorted(r["k"] for r in drop_rows(rows, own, {"k": F.col("k")}).collect()) == [k for k in range(2000) if k % 7]
