"""Text operators against brute force on small tables, and the cases that data throws at them."""

import hashlib
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from shelfcast.llm import bpe, decontaminate, exact_dedup, langid, ngram_join, pii, toxicity, url_filter  # noqa: E402
from shelfcast.llm.graph_dedup import cut_spans  # noqa: E402
from shelfcast.llm.queries import QUERIES, SQL  # noqa: E402
from shelfcast.llm.suffix_dedup import cut_repeats  # noqa: E402
from shelfcast.session import build_session, materialise  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def spark():
    s = build_session("llm-tests", master="local[4]", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, copies and near copies, and columns that clash with results."""
    base, long = words(1, 60), words(2, 4000)
    near = base.replace(base.split()[30], "zzz", 1)
    passage = words(3, 45)
    rows = [(1, base, "en"), (2, base.replace(" ", "\n\t ", 3), "en"), (3, near, None), (4, None, None), (5, "", "de"), (6, long, "en"), (7, long, "en"),
            (8, words(4, 30) + " " + passage + " " + words(5, 30), "fr"), (9, words(6, 30) + " " + passage, "fr"), (9, "same id", "fr"), (9, "same id", "fr"),
            (None, base, "en"), (10, "a b a b " * 100, "en"), (11, "x", "en"), (12, "!!! 123 ---", "en")]
    return spark.createDataFrame([(i, t, g, "s", 1, True, "k") for i, t, g in rows], DOCS + ", kept boolean, rule string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def agree(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    agree([tuple(r[c] for c in cols) for r in df.collect()], cur.fetchall())


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/x?y", "http://example.org/en/12", "https://example.orgx/es/", "http://x.com", "http://com/de/", "nourl", None, "", "http://b.com/fr/#a", "x://y.net://z"]
    df = spark.createDataFrame([(u, "clash") for u in urls], "url string, rule string")
    got = [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.PAGE_RULES).collect()]
    agree(got, [(urls[0], "a.example.org", "/es/x", "example.org/es/", "block"), (urls[1], "example.org", "/en/12", "example.org/en/1", "block"),
                (urls[2], "example.orgx", "/es/", None, "allow"), (urls[3], "x.com", "", None, "allow"), (urls[4], "com", "/de/", "com/de/", "block"),
                ("nourl", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), (urls[8], "b.com", "/fr/", "com/fr/", "allow"),
                (urls[9], "y.net:", "//z", None, "allow")])
    many = [url_filter.Rule("block", f"h{i}.net", "/") for i in range(url_filter.MAX_INLINE + 5)]
    hit = spark.createDataFrame([("http://h0.net/",), (f"http://h{len(many) - 1}.net/",), ("http://h.net/",)], "url string")
    assert [r["verdict"] for r in url_filter.judge_urls(hit, many).orderBy("url").collect()] == ["allow", "block", "block"]
    assert url_filter.judge_urls(df.limit(0), url_filter.PAGE_RULES).count() == 0


def test_exact_dedup(odd, none):
    rows = exact_dedup.group_exact(odd).collect()
    norm = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in odd.collect()]
    size = Counter(t for _, t in norm)
    first = {}
    for i, t in sorted(norm, key=lambda x: (x[0] is not None, x[0] or 0)):
        first.setdefault(t, i)
    want = [(i, first[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]
    agree([(r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], want)
    assert sum(r["kept"] for r in rows) == len(size)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(size) and exact_dedup.drop_copies(none).count() == 0


def test_hot_copies_are_sliced(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(400)] + [(i, f"t{i}") for i in range(400, 500)], "doc_id long, text string")
    rows = exact_dedup.group_exact(df).collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["id"] < 400} == {(0, 400)}
    assert [r["id"] for r in rows if r["kept"] and r["id"] < 400] == [0]


def in_order(odd):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return rows


def test_suffix_dedup(odd, none):
    seen, want = set(), []
    for i, t in in_order(odd):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    agree([tuple(r)[:5] for r in cut_repeats(odd).collect()], want)
    assert cut_repeats(none).count() == 0


def test_graph_dedup(odd, none):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in in_order(odd)]
    count = Counter(tuple(w[s:s + 35]) for _, w in texts for s in range(len(w) - 34))
    want = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s:s + 35])] > 1:
                gone[s:s + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    agree([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in cut_spans(odd).collect()], want)
    assert cut_spans(none).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[s:s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join(odd, none, monkeypatch):
    rows = in_order(odd)
    sets = [shingles(t) for _, t in rows]
    rep = [next(j for j in range(len(rows)) if sets[j] == sets[k]) if sets[k] else k for k in range(len(rows))]
    linked = {k: [j for j in set(rep) if j != k and sets[j] and sets[k] and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])] for k in set(rep)}
    for block in (ngram_join.BLOCK, 1):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.join_similar(odd).collect()
        agree([(r["doc_id"], r["rep_id"], r["n_links"]) for r in got], [(rows[k][0], rows[rep[k]][0], len(linked[rep[k]])) for k in range(len(rows))])
    left = ngram_join.drop_similar(odd)
    assert left.columns == odd.columns
    heads = {min([rep[k], *linked[rep[k]]]) for k in range(len(rows))}
    assert left.count() == len(heads)
    assert ngram_join.drop_similar(none).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v) // 10 + (2 * v) % 10 for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in KINDS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    texts = [None, "", "é a.b@c.de_x@y.z 1.2.3.4 1.2.3.999 4.3.2.1.5.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (212) 555-0100 +12", "9" * 20000, "x" * 20000 + "@a.b",
             "a@b.c" * 3, "007.08.0009.1 0000000000000000000000001.1.1.1", "@@ + .", "1 " * 700, " ".join(f"10.0.{i * 9}.7" for i in range(30)),
             " ".join(f"10.0.{i % 300}.7 u{i}@h.org" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[2])], "doc_id long, text string")
    for r in pii.find_personal(df).collect():
        t = texts[2] if r["doc_id"] == 1 and r["n_email"] else texts[r["doc_id"]] or ""
        want = base_spans(t)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:50]
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in want) for k in KINDS]
    assert pii.find_personal(df.limit(0)).count() == 0


def test_bpe_matches_the_library(spark, odd, none):
    lib = Tokenizer.from_file(PATH)
    vocab = bpe.vocabulary(PATH)
    rng = random.Random(5)
    texts = [r["text"] or "" for r in odd.collect()] + ["Don't NAÏVE İΣ <|endoftext|>x", "１２½ ſ's \x00\x1f", "日本語" * 50, "".join(rng.choice("inthea!?9é ") for _ in range(9000)), "ab" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_digests(df, PATH, with_ids=True).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for k in range(200):
        symbols = list(vocab.symbols("".join(rng.choice("inthearo") for _ in range(400))))
        assert list(vocab.merges.stream(symbols, 1)) == vocab.merges.apply(symbols)
    parts = bpe.TextDecoder(vocab)
    assert "".join(parts.feed([i]) for i in vocab.encode("crème brûlée 日本")) == "crème brûlée 日本 "
    assert bpe.encode_digests(none, PATH).count() == 0


def test_bpe_takes_long_texts_block_by_block(monkeypatch):
    lib, vocab = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "TEXT_BLOCK", 50)
    text = "".join(rng.choice(["the ", "don't", "É", "e\u0301", " \u0301", "\n", "\t", "日本", "Σας ", "3", "!? ", "<|endoftext|>", "ſ", "a" * 90]) for _ in range(3000))
    ids = lib.encode(text, add_special_tokens=False).ids
    blocks = [np.frombuffer(b, "<u4").tolist() for b in vocab.pieces(text)]
    assert len(blocks) > 100 and [i for b in blocks for i in b] == ids
    decoder = bpe.TextDecoder(vocab, spelled=False)
    assert "".join(decoder.feed(b) for b in blocks) + decoder.feed((), True) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_memory_is_bounded():
    vocab, rng = bpe.vocabulary(PATH), random.Random(1)
    text = " ".join("".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(3, 12))) for _ in range(250_000))
    tracemalloc.start()
    for piece in vocab.pieces(text):
        assert piece
    held, peak = tracemalloc.get_traced_memory()
    assert peak < 60 << 20 and len(vocab.new) + len(vocab.old) <= 2 * bpe.WORDS_KEPT
    vocab.forget()
    assert tracemalloc.get_traced_memory()[0] < 2 << 20 < held
    tracemalloc.stop()


def test_toxicity_uses_every_lexicon_word(spark):
    docs = [(i, f"you {('idiot', 'moron')[i % 2]} " + words(i, 30) if i < 40 else words(i, 30)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert model.score("you imbecile vermin") > model.score("you table lamp") and model.score("you clown") > model.score("you")


def test_decontamination(spark, none):
    item = "In the shop the clerk Anna sold 12 apples for 3 dollars and then sold 12 pears for 5 dollars to the old friend called Bert"
    redo = item.replace("12", "40").replace("Anna", "Greta").replace(" 3 ", " 9 ")
    rows = [(1, "xx yy " + item + " zz"), (2, redo), (3, item.replace("12 apples", "40 apples").replace("Anna", "Greta")), (4, None), (5, "the old friend called"),
            (None, item), (6, words(1, 500)), (7, item), (7, item), (8, "1 2 3 4 5 " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "two words")], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    agree([(r["doc_id"], r["item_id"], r["kind"]) for r in got], [(1, 7, "copy"), (2, 7, "reworked"), (None, 7, "copy"), (7, 7, "copy")])
    left = decontaminate.drop_leaks(docs, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_are_dropped_row_by_row(spark):
    item = "in the shop the old clerk sold twelve red apples and then seven green pears to a friend who paid at once"
    rows = [(5, "so " + item, "a"), (5, "nothing here at all", "b"), (None, item, "c"), (None, "also clean", "d"), (6, None, "e"), (5, "nothing here at all", "b")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kind string, rid int")
    left = decontaminate.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r["kind"] for r in left.collect()) == ["b", "b", "d", "e"]


def test_decontamination_judges_each_occurrence(spark):
    item = "a farmer with 11 cows and 12 goats bought 13 ducks and then sold 11 cows to a friend who paid 14 coins for 12 goats and the rest"
    first, second = (item.replace("11", a).replace("12", b).replace("13", c).replace("14", d) for a, b, c, d in (("90", "20", "7", "65"), ("3", "85", "41", "5")))
    mixed = first.replace("sold 90", "sold 11")
    rows = [(1, first + " . " + second), (2, first), (2, second), (3, first + " " + words(1, 90) + " the barn with 77 cows and 5 goats bought nothing"),
            (4, mixed), (5, first.replace("bought", "gladly bought"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    agree([(r["doc_id"], r["kind"]) for r in got], [(1, "reworked"), (2, "reworked"), (3, "reworked"), (5, "reworked")])


def test_decontamination_finds_copies_of_dense_items(spark):
    items = [(1, "3 + 4 * 5 - 6 / 2 = 8 + 9 - 1"), (2, "Anna Bert, Carl Dora, Emil Fritz, Gina Hans"), (3, "room 12"),
             (4, "what is the next number of the series 2 3 5 7 11 13 17 19 23 29 31 37")]
    rows = [(1, "solve 3 + 4 * 5 - 6 / 2 = 8 + 9 - 1 now"), (2, "we saw Anna Bert, Carl Dora, Emil Fritz, Gina Hans there"), (3, "go to room 12 or room 14"),
            (4, items[3][1]), (11, "solve 3 + 4 * 5 - 7 / 2 = 9 + 9 - 1 now"), (13, "room 13"), (14, "what is the next number of the series 4 6 8 9 10 12 14 15 16 18 20 21")]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    agree([(r["doc_id"], r["item_id"], r["kind"]) for r in got], [(1, 1, "copy"), (2, 2, "copy"), (3, 3, "copy"), (4, 4, "copy"), (14, 4, "reworked")])


def test_decontamination_takes_sentence_openers_for_names(spark):
    item = "Tom has 5 apples in the bag. Tom gives 3 apples to the girl. How many apples are left?"
    redo = item.replace("Tom", "Anna")
    rows = [(1, redo), (2, "Here it is: " + redo), (3, '"' + redo + '"'), (4, item.lower()), (5, item.replace("Tom gives", "Anna gives")), (6, "so " + item), (7, words(1, 80))]
    other = "The cat sat on the warm mat by the old door. The dog ran over the wide green field to the small river and slept there"
    rows += [(8, other.replace("The cat", "A cat"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    agree([(r["doc_id"], r["item_id"], r["kind"]) for r in got], [(1, 1, "reworked"), (2, 1, "reworked"), (3, 1, "reworked"), (4, 1, "copy"), (6, 1, "copy"), (8, 2, "copy")])


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    out = langid.predict_languages(odd, langid.fit_languages(docs))
    assert {r["lang_pred"] for r in out.filter("text is null or text = '' or text like '!!!%'").collect()} == {"und"} and out.count() == odd.count()
    assert langid.predict_languages(none, langid.fit_languages(none)).count() == 0


def test_language_scores_do_not_depend_on_the_step(monkeypatch):
    texts = ["", "ab", words(1, 400), "é" * 90, words(2, 3), "x", words(3, 150), ""]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    model = langid.LanguageModel(("a", "b", "c"), np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.zeros(3), 1.0, 0.1)
    whole = model.probabilities(data, offsets)
    one_by_one = np.vstack([model.probabilities(data[a:b], np.array([0, b - a])) for a, b in zip(offsets, offsets[1:])])
    assert np.allclose(whole, one_by_one)
    for step in (1, 7, 64):
        monkeypatch.setattr(langid, "STEP", step)
        assert np.allclose(whole, model.probabilities(data, offsets))


def test_toxicity(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85 and np.mean([s >= 0.7 for s in clean]) < 0.05
    for sf, least in (("sf0.001", 0.7), ("sf0.01", 0.75)):  # few labels: the written lexicon carries the model; texts without evidence tie
        few = QUERIES["op6_toxicity"](spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").collect()
        assert np.mean([(r["score"] > s["score"]) + (r["score"] == s["score"]) / 2 for r in few for s in few if r["toxic"] == 1 and s["toxic"] == 0]) > least
    assert not any(r["predicted"] for r in few if r["toxic"] == 0)
    model = toxicity.fit_toxicity(odd, labels.limit(0))
    assert toxicity.score_toxicity(odd, model).filter("score > 0.5").count() == 0 and toxicity.score_toxicity(none, model).count() == 0


def test_toxicity_lexicon_is_checked_against_labels():
    sets, y = [{"fool"}, {"fool", "vile"}, {"vile"}, {"vile"}, {"tree"}], np.array([1, 1, 0, 0, -1])
    assert not toxicity.contradicted("fool", sets, y) and toxicity.contradicted("vile", sets, y) and not toxicity.contradicted("scum", sets, y)


def test_pipeline_stages_keep_clashing_columns(spark):
    clash = ("score", "lang_pred", "rejected", "row", "_", "rid", "id", "norm", "judged", "w", "kept")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        assert out.filter(" or ".join(f"`{c}` is null or `{c}` <> concat('{c}', doc_id)" for c in clash)).isEmpty()
        docs = out


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs, before = out, want
        want = {(r["doc_id"], r["text"]) for r in out.collect()}
        assert want <= before
        if name == "language_id":
            assert want == before
        if name == "exact_dedup":
            first = {}
            for i, t in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert {i for i, _ in want} == set(first.values())
        if name == "ngram_join":
            pairs = {(i, j) for i, s in before for j, t in before if i < j and len(shingles(s) & shingles(t)) >= 0.8 * len(shingles(s) | shingles(t))}
            assert {i for i, _ in before} - {i for i, _ in want} == {j for _, j in pairs}
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(want)
