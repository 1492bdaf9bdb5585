"""The training-data operators against the tokenizers, brute force and round trips, on small tables."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from creel.llm import arrow, chat_format, decontaminate, jaccard_join, kneser_ney, language_id, packing, quality_rules, queries, token_counts, toxicity, url_filter
from creel.llm.components import components

SF = "/root/testdata/sf0.001"
SIGNS = ["'", " ", "  ", "\n", "\t", "s", "re", "ll", "'s", "é", "e\u0301", "中文", "1", "23", "!", "...", "a", "The", "ing", " ", "😀", "x" * 9, "'l", "'V", "K", "(a)", "»", "."]
# nulls, empty and blank texts, repeated rows, a clashing column, a long text
ROWS = [(1, None, "en", "s"), (2, "", None, None), (3, " \n\t", "en", "s"), (4, "tiny words here", "en", "s"), (4, "tiny words here", "en", "s"), (None, "no id but a text", "en", None), (6, "word " * 60000, "en", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


def strings(n, more=()):
    r = random.Random(3)
    return ["".join(r.choice([*SIGNS, *more]) for _ in range(r.randrange(50))) for _ in range(n)]


def odd(spark, empty=False):
    df = spark.createDataFrame([] if empty else ROWS, SCHEMA)
    return df.withColumn("__text", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("key", F.lit(2))


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer(name))


@pytest.mark.parametrize("chunk", [7, 2048])
def test_transducer_counts_as_the_library_does(chunk):
    texts = strings(800, ["<|endoftext|>"]) + ["", "x" * 3000, " " * 3000]
    machine = token_counts.Transducer(queries.tokenizer("byte_bpe_50k.json"), max_states=3000)
    got = machine.counts(*arrow.buffers(pa.array(texts)), chunk)
    assert got.tolist() == [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_odd_rows(spark):
    got = token_counts.token_counts(odd(spark), queries.tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == len(ROWS) and {r["doc_id"]: r["n_tokens"] for r in got}[1] == 0
    assert [r["over_limit"] for r in got if r["doc_id"] == 6] == [True]
    assert token_counts.token_counts(odd(spark, True), queries.tokenizer("byte_bpe_50k.json")).count() == 0


def test_encoder_gives_the_librarys_ids():
    encoder, want = packing.Encoder(queries.tokenizer("word_bpe_49k.json")), library("word_bpe_49k.json")
    for more in ((), ("<|endoftext|>", "<|ENDOFTEXT|>")):
        texts = strings(400, more)
        flat, n = encoder.ids(*arrow.buffers(pa.array(texts)))
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [e.ids for e in want.encode_batch(texts, add_special_tokens=False)]


def test_differencing_keeps_sums_and_capacity():
    sizes = np.random.default_rng(1).integers(1, 900, 400)
    window, n = packing.divide(sizes, 4096)
    filled = np.bincount(window, sizes, n)
    assert filled.sum() == sizes.sum() and filled.max() <= 4096 and filled.min() > 3600


def test_packing_places_each_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    docs = docs.union(odd(spark).select(*docs.columns).where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**6).dropDuplicates(["doc_id"]))
    rows = packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), 2).toPandas()
    encoder = library("word_bpe_49k.json")
    for doc, text in docs.select("doc_id", "text").collect():
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == doc].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 4096
    assert packing.pack(odd(spark, True), queries.tokenizer("word_bpe_49k.json"), 2).count() == 0


def test_quality_counts_by_brute_force(spark):
    got = queries.op2_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = {x: windows.count(x) for x in set(windows)} if len(windows) < 2000 else __import__("collections").Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in quality_rules.SYMBOLS), dup, len(covered))
        assert tuple(got.loc[doc, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want


def test_quality_of_odd_rows(spark):
    got = quality_rules.quality_rules(odd(spark)).collect()
    assert len(got) == len(ROWS) and not any(r["kept"] for r in got)
    assert [r["n_repeat_words"] for r in got if r["doc_id"] == 6] == [60000]
    assert quality_rules.quality_rules(odd(spark, True)).count() == 0


def test_quality_limits_of_small_and_bad_groups(spark):
    r = random.Random(4)
    clean = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    bad = lambda: clean().replace("a", "#").replace("b", "#").replace("c", "#").replace("d", "#")
    rows = [(f"clean{i}", clean(), "en", f"s{i % 3}") for i in range(120)]
    # groups of one text, of a rare and of no language, a source of 40 % and one of 70 % bad texts
    rows += [("bad", bad(), "en", "one"), ("clean", clean(), "en", "two"), ("bad", bad(), "xx", "s0"), ("bad", bad(), None, None), ("clean", clean(), None, "s1")]
    rows += [("bad" if i % 10 < 4 else "clean", bad() if i % 10 < 4 else clean(), "en", "spam") for i in range(30)]
    rows += [("bad" if i % 10 < 7 else "clean", bad() if i % 10 < 7 else clean(), "yy", "copies") for i in range(30)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and not any(x["base_failed"] for x in got)
    assert [x["doc_id"] for x in got if x["kept"] != x["doc_id"].startswith("clean")] == []


def test_quality_limits_follow_a_large_source(spark):
    rows = [("a" if i < 200 else "b", *[x / 1000 * (i % 100) / 100 + (i >= 200) * x / 100 for x in (1, 2, 3, 4, 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, ["g", *quality_rules.MARGINS])
    got = {x["g"]: x for x in quality_rules.thresholds(df, ["g"]).collect()}
    assert all(0 < got["b"][f"max_{m}"] - got["a"][f"max_{m}"] <= 0.05 + 1e-9 for m in quality_rules.MARGINS)


def test_chat_digests_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b \\: <s>", "", None, "<</SYS>><<SYS>>\n]"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "odd]\n[role", "x"), (2, 0, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat_format.chat_format(df)
    for r in parts.collect():
        body = r["formatted"][len("<s>[") : -len("</s>")]
        assert not any(c in body for c in chat_format.CONTROL)
        assert chat_format.read_back(r["formatted"]) == [(r["role"], r["text"])]
    got = {r["conv_id"]: r for r in chat_format.digests(parts).collect()}
    said = "".join(t or "" for i, t in enumerate(texts) if i % 2)
    turns = "".join(f"{'assistant' if i % 2 else 'user'}\n{t or ''}\n" for i, t in enumerate(texts))
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2]["n_turns"] == 2


@pytest.mark.parametrize(
    ("schema", "row"),
    [
        ("messages array<struct<role:string,content:string>>", ([("user", "q"), ("assistant", "a")],)),
        ("conversations array<struct<from:string,value:string>>", ([("human", "q"), ("gpt", "a")],)),
        ("prompt string, response string, extra int", ("q", "a", 1)),
        ("instruction string, input string, output string", ("q", "", "a")),
    ],
)
def test_layouts_become_turns(spark, schema, row):
    df = spark.createDataFrame([(5, *row)], f"conv_id long, {schema}")
    assert [tuple(r) for r in chat_format.canonical_turns(df).orderBy("turn").collect()] == [(5, 0, "user", "q"), (5, 1, "assistant", "a")]


def test_toxicity_and_language_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 0), (4, 1), (6, None)], "doc_id long, toxic int")
    for labelled in (labels, labels.where("false")):
        got = toxicity.toxicity(odd(spark), labelled).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(odd(spark, True), labels).count() == 0
    got = language_id.language_id(odd(spark)).collect()
    assert len(got) == len(ROWS) and {r["doc_id"]: r["lang_pred"] for r in got}[1] == "und"
    assert language_id.language_id(odd(spark, True)).count() == 0


def test_language_held_out(spark):
    got = language_id.language_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    right = got.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert right.where("lang = lang_pred").count() >= 0.95 * right.count()


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghijklmnop") + str(r.randrange(9)) for _ in range(r.randrange(4, 70))) for _ in range(20)]
    rows = []
    for t in texts:
        w = t.split()
        for _ in range(r.randrange(1, 8)):
            v = list(w)
            for _ in range(r.randrange(0, 4)):
                v[r.randrange(len(v))] = r.choice(["Q", "z9"])
            rows.append(" ".join(v))
    rows += ["", None, " ", "one", "ONE", "one two"]
    table = list(enumerate(rows))
    got = jaccard_join.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(table)


def test_groups_hold_classes_that_come_from_several_tasks():
    rows = [(1, 7, 50), (1, 3, 52), (1, 3, 52), (1, 3, 52), (2, 3, 52), (2, 3, 52), (4, 3, 52), (4, 3, 52), (4, 5, 53), (4, 5, 53)]
    for size in range(1, len(rows) + 1):
        batches = [jaccard_join.frames(**{name: (x, jaccard_join.LONG) for name, x in zip(("key", "class", "n"), zip(*rows[i : i + size], strict=True), strict=True)}) for i in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in jaccard_join.grouped(80)(iter(batches)) for x in b.to_pylist()]
        assert got == [(1, 7, 50, 7), (1, 3, 52, 7), (4, 3, 52, 3), (4, 5, 53, 3)]


def test_near_duplicates_with_copies_in_other_partitions(spark, tmp_path):
    r = random.Random(8)
    table = []
    for k in range(8):
        w = [r.choice("abcdefghijklmnop") + str(r.randrange(99)) for _ in range(40 + k)]
        # two exact copies and a near one, which is shorter or longer
        near = w[: -1 - k % 3] if k % 2 else [*w, "more"]
        table += [(10 * part + k, " ".join(x)) for part, x in enumerate([near, w, w])]
    for part in range(3):
        mine = [x for x in table if x[0] // 10 == part]
        spark.createDataFrame(mine, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for df in (docs, docs.repartition(24, "doc_id")):
        got = jaccard_join.near_duplicates(df).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(table)


def test_near_duplicates_of_no_rows(spark):
    assert jaccard_join.near_duplicates(odd(spark, True)).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    r = random.Random(9)
    a, b, c, d, e, f = (" ".join(r.choice("abcdefghijklmnop") + str(r.randrange(99)) for _ in range(40)) for _ in range(6))
    rows = [
        *[(1, a), (None, f"{a} more"), (None, b), (None, None)],  # a null id is a copy, others are not
        *[(2, c), (3, f"{c} more"), (3, d)],  # one of two texts of an id is a copy of a smaller id
        *[(4, e), (4, e), (4, f"{e} more")],  # repeated rows
        *[(None, f), (None, f"{f} more"), (None, f)],  # a group without an id
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(x) for x in corpus_pipeline.distinct(spark, docs, SF).collect()]
    assert len(got) == 7 and {(1, a), (None, b), (None, None), (2, c), (3, d)} <= set(got)
    assert [i for i, t in got if (t or "").startswith(e)] == [4] and [i for i, t in got if (t or "").startswith(f)] == [None]


def test_tiles_find_what_small_blocks_find():
    sets = [np.unique(np.random.default_rng(i // 3).integers(0, 1 << 60, 80))[: 78 - i % 3] for i in range(12)]
    rows = [(i, len(s), i, True, 0, jaccard_join.bitmap(s, jaccard_join.own_bits(len(s))).tobytes()) for i, s in enumerate(sets)]
    found = set(jaccard_join.tile_pairs(rows, 80))
    assert found >= {(a, b) for a in range(12) for b in range(a) if a // 3 == b // 3}
    best = list(jaccard_join.tile_pairs(rows, 80, best=True))
    assert set(best) <= found and len(best) < len(rows) and {i // 3 for pair in best for i in pair} == set(range(4))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60)], "u long, v long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 51: 50}


def kneser_ney_by_hand(train, text):
    """Sum of logarithms of a text's characters, from the definition."""

    def cut(t):
        t = re.sub("[ \\t-\\r]+", " ", t)
        return [(("\x02" * 3 + t)[i : i + 3], t[i]) for i in range(len(t))]

    tables = {3: Counter(g for t in train for g in cut(t))}
    for k in (2, 1, 0):
        tables[k] = Counter((h[1:], w) for h, w in tables[k + 1])
    cuts = {}
    for k, table in tables.items():
        n = Counter(table.values())
        n1, n2, n3, n4 = (max(n[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[k] = [min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]

    def chance(h, w, k):
        if k < 0:
            return 1 / (len(tables[0]) + 1)
        after = {x: c for (g, x), c in tables[k].items() if g == h}
        if not after:
            return chance(h[1:], w, k - 1)
        total, off = sum(after.values()), [cuts[k][min(c, 3) - 1] for c in after.values()]
        own = after[w] - cuts[k][min(after[w], 3) - 1] if w in after else 0
        return own / total + sum(off) / total * chance(h[1:], w, k - 1)

    return sum(log(chance(h, w, 3)) for h, w in cut(text))


def test_kneser_ney_by_the_definition(spark):
    train = ["abracadabra abra", "cadabra  \tdabra", "abra abra", "a cab", ""]
    texts = [*train, "zebra", "ab" * 30, "中文 abra", "\n", "x", "a" * 70]
    table = kneser_ney.model(spark.createDataFrame([(t,) for t in train], "__text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, __text string")
    for most in (20, 1 << 25):  # many blocks, one for each task
        got = {r["i"]: r for r in kneser_ney.scores(docs, table, most).collect()}
        assert set(got) == set(range(len(texts)))
        for i, text in enumerate(texts):
            assert got[i]["logs"] == pytest.approx(kneser_ney_by_hand(train, text), abs=1e-9)
    assert got[4]["chars"] == 0 and got[8]["chars"] == 1
    assert kneser_ney.scores(docs.limit(0), table).count() == 0
    # what follows a context sums up to one, a character never seen included
    chars = [*{c for t in train for c in t.replace("\t", " ")}, "中"]
    for context in ("abr", "zzz", "ra "):
        asked = spark.createDataFrame([(sum(ord(c) << 21 * k for k, c in enumerate(reversed(context))), ord(c)) for c in chars], "h long, w long")
        assert sum(np.exp(r["log"]) for r in kneser_ney.resolved(asked, table).collect()) == pytest.approx(1)


def test_trusted_pieces_are_counted_where_they_lie(spark):
    """The texts are not shuffled to find the trusted; repeated, null and unknown ids as in a join of the texts."""
    texts = [(i % 40 if i % 9 else None, f"text {i} " + "abc" * (i % 5) + "é" * (i % 2), i % 4 == 0) for i in range(120)]
    docs = spark.createDataFrame(texts, "__id long, __text string, __out boolean").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in (*range(0, 40, 3), None, 999)], "__id int")
    joined = docs.where("NOT __out").join(trusted, "__id", "left_semi").select("__text")
    want = sorted(map(tuple, kneser_ney.counts(joined).collect()))
    assert len(want) > 100
    for most in (50, 1 << 25):
        blocks = kneser_ney.packed(docs, most, "__id").localCheckpoint()
        pieces = blocks.where("rows IS NOT NULL")
        got = kneser_ney.counts_in(pieces, trusted, "__id", "__out")
        assert sorted(map(tuple, got.collect())) == want
        assert sorted(k for r in pieces.select("keys").collect() for k in r["keys"] if k is not None) == sorted(i for i, _, _ in texts if i is not None)
    assert kneser_ney.counts_in(pieces, trusted.limit(0), "__id", "__out").count() == 0


def test_texts_of_a_language_lie_together_in_large_pieces(spark, monkeypatch):
    """What is written and shuffled is compressed over more than a slice, and the slices of a piece give the same scores."""
    rng = np.random.default_rng(3)
    words = {lang: ["".join(rng.choice(list(letters), 6)) for _ in range(200)] for lang, letters in (("a", "abcdefgh"), ("b", "éèàùôïñç"), (None, "12345678"))}
    texts = [(i, [*words][i % 3], " ".join(rng.choice(words[[*words][i % 3]], 300))) for i in range(900)] + [(900, "b", ""), (901, None, "a"), (902, "a", " \n ")]
    docs = spark.createDataFrame(texts, "__id long, __lang string, __text string").coalesce(1)

    def pieces(alike):
        return kneser_ney.packed(docs, key="__id", alike=alike).where("rows IS NOT NULL").collect()

    apart, together = pieces(None), pieces("__lang")
    assert len(apart) == len(together) == 1
    assert sorted(together[0]["keys"]) == sorted(apart[0]["keys"]) == list(range(903))
    langs = [texts[k][1] for k in together[0]["keys"]]
    assert langs == sorted(langs, key=lambda x: (x is None, x or ""))
    assert len(together[0]["rows"]) < len(apart[0]["rows"])

    table = kneser_ney.model(docs.limit(100).select("__text"))
    trusted = docs.select("__id").where("__id % 2 = 0")
    found = []
    for size, alike in ((1 << 20, None), (5000, "__lang")):
        monkeypatch.setattr(kneser_ney, "SLICE", size)
        blocks = kneser_ney.packed(docs.withColumn("__out", docs["__id"] % 3 == 0), 1 << 20, "__id", alike).localCheckpoint()
        got = kneser_ney.block_scores(blocks, docs.schema, table).collect()
        counted = kneser_ney.counts_in(blocks.where("rows IS NOT NULL"), trusted, "__id", "__out").collect()
        found.append((sorted((r["__id"], r["__lang"] or "", r["logs"], r["chars"]) for r in got), sorted(map(tuple, counted))))
    assert len(found[0][0]) == 903 and found[0] == found[1]


def test_pairs_of_few_and_of_many_characters():
    for alphabet in (5, 1 << 20):
        r = np.random.default_rng(2)
        c = r.integers(3, 3 + alphabet, 200_000)
        text = pa.array(["".join(map(chr, np.where((c >= 0xD800) & (c < 0xE000), 65, c)))])
        context, char, _ = kneser_ney.places(text)
        h, w, which = kneser_ney.pairs(context, char)
        again, _, often = kneser_ney.pairs(context, char, often=True)
        assert (again == h).all() and (often == np.bincount(which)).all()
        assert (h[which] == context).all() and (w[which] == char).all() and often.sum() == len(char)
        assert (np.lexsort((w, h)) == np.arange(len(h))).all() and len(set(zip(h, w))) == len(h)


def test_quality_classifier_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = kneser_ney.quality_classifier(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(got) == docs.count() and sum(r["kept"] for r in got) > 0.8 * len(got)
    got = kneser_ney.quality_classifier(odd(spark), spark.createDataFrame([(4, 1)], "doc_id long, quality int")).collect()
    assert len(got) == len(ROWS) and all(r["kept"] for r in got)
    named = odd(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    none = spark.createDataFrame([], "doc_id string, quality int")
    assert kneser_ney.quality_classifier(named, none).where("kept").count() == len(ROWS)
    assert kneser_ney.quality_classifier(odd(spark, empty=True), none).count() == 0


def test_decontamination_finds_edited_passages(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly boxed a dozen jugs."
    near = item.replace("brown", "brwn").replace("seven", "sevven").upper()
    docs = [(1, "x " * 40 + item + " y" * 40), (2, f"intro\n{near}  end"), (3, "nothing of the kind is in this text at all"), (4, item[:40]), (5, None), (6, "")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.passages_in(df, bench).collect()}
    assert got == {(1, 7): 0, (2, 7): 2}
    flags = df.select("doc_id", decontaminate.contaminated(F.col("text"), bench).alias("c")).where("c").collect()
    assert {r[0] for r in flags} == {1, 2}
    assert decontaminate.passages_in(df, bench.where("false")).count() == 0


def test_decontamination_needs_memory_for_hits_only():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))
    items, texts = [word() for _ in range(4000)], [word() for _ in range(5000)]
    texts[7], texts[4999] = f"so {items[3]}", items[3999]
    held = decontaminate.Passages(list(range(len(items))), items, 10)
    tracemalloc.start()
    try:
        found = [x[:2] for x in held.matches(pa.array(texts))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [(7, 3), (4999, 3999)]
    assert most < 64 << 20  # a counter for every text and passage is 160 MB


def test_url_rules_by_brute_force(spark):
    urls = ["http://A.Example.COM/en/x?q", "https://www.example.com/en/1", "x://net/es/", "x://a.net/fr/b", "x://a.net", "no url", None, "x://b.org/#/en/", "x://notexample.com/en/", "x://://com/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.url_filter(rows).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in url_filter.RULES if (host == (h := x.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + x.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == url_filter.RULES[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert url_filter.url_filter(rows.where("false")).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as the counts, verdicts and keys of the operators are; null, empty, repeated and long rows."""
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("ra", "lo", "mi", "te", "su", "ve") for b in ("ne", "do", "kal", "pir", "sta")]
    say = lambda n: " ".join(r.choice(words) + (f"{r.randrange(50)}" if r.random() < 0.3 else "") for _ in range(n)) + "."
    texts = [say(120) for _ in range(30)] + [None, "", " ", "few words", say(30000)]
    # ids without labels: nothing is learned, so nothing is toxic
    rows = [(i, t, r.choice(["en", None]), r.choice(["a", "b", None]), f"n{i}", i % 2 == 0, f"l{i}", [str(i)], i * 7, 0.5 + i, f"r{i}") for i, t in enumerate(texts, 10**6)]
    rows += [rows[3], rows[3], (None, texts[0] + " end", "en", "a", "x", None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_words string, kept boolean, __l string, __lines array<string>, __row long, symbol_share double, row string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    given = {repr(tuple(x)) for x in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.scratch.written(stage(spark, now, SF))
        assert now.columns == docs.columns, name
        assert {repr(tuple(x)) for x in now.collect()} <= given, name
        none = stage(spark, docs.limit(0), SF)
        assert none.columns == docs.columns and none.count() == 0, name
    kept = now.select("doc_id", "__row", "kept").collect()
    assert 25 <= len(kept) <= 31 and all(x["__row"] == x["doc_id"] * 7 and x["kept"] == (x["doc_id"] % 2 == 0) for x in kept)
    pieces = corpus_pipeline.packed(spark, now, SF)
    assert {x["doc_id"] for x in pieces.collect()} == {x["doc_id"] for x in kept}
    assert corpus_pipeline.packed(spark, docs.limit(0), SF).count() == 0


def test_texts_without_a_letter_have_no_language(spark):
    signs = ["\U0001d7d8\U0001d7d9", "\U00010100", "\U000e0041", "12 34", "😀", "", None]
    rows = [(i, "the cat sat on the mat and the dog " * 3, "en") for i in range(20)] + [(100 + i, t, None) for i, t in enumerate(signs)]
    rows += [(200, "\U00010428\U00010429 the dog", None)]
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + i] for i in range(len(signs))] == ["und"] * len(signs) and got[200] == "en"


def test_out_of_place_distance_by_hand():
    """Ties by the smaller number; an n-gram outside the profile counts as the profile's length."""
    one, two, three, _ = language_id.grams(pa.array(["aab"]))
    found, n = language_id.counted_grams([one, two, three])
    order = sorted(zip((-n).tolist(), found.tolist(), strict=True))
    ranked = [g for _, g in order]
    model = language_id.Profiles(["x"] * 2 + ["y"] * 2, np.array([ranked[0], ranked[2], ranked[1], 7]), np.array([0, 1, 0, 1]), 5)
    top = ranked[:5]
    far = {}
    for lang, profile in {"x": [ranked[0], ranked[2]], "y": [ranked[1], 7]}.items():
        far[lang] = sum(abs(profile.index(g) - i) if g in profile else 5 for i, g in enumerate(top))
    langs, scores = model.nearest(pa.array(["aab"]))
    best = min(far, key=lambda k: (far[k], k))
    assert langs == [best] and scores[0] == pytest.approx(1 - far[best] / (5 * len(top)))


def test_profiles_are_cut_before_the_shuffle(spark, capsys):
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    language_id.profiles(docs).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


@pytest.mark.parametrize("role", ["/INST", "INST", "user", "a]\nb", "\\/INST", "\\:INST"])
def test_role_and_template_make_no_control_string(spark, role):
    df = spark.createDataFrame([(1, 0, role, "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    parts = sorted(chat_format.chat_format(df).collect(), key=lambda x: x["turn"])
    inner = parts[0]["formatted"]
    assert chat_format.read_back(inner + parts[1]["formatted"]) == [(role, "hi"), ("assistant", "yo")]
    assert not any(c in inner[1:-1] for c in ("[INST]", "[/INST]"))


def test_labels_of_ids_that_are_not_numbers(spark):
    rows = [(f"d{i}", "awful bad insult" if i % 2 else "lovely good praise") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 60 and all(0 <= x["score"] <= 1 for x in got)
