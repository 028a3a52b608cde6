"""Text operators against brute force, and their defined results on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import attention_mil, context_mixing, fm_index, hyperminhash, keybits, patience, ppm
from vellum.llm import textbytes as tb
from vellum.llm.runtime import Scratch, written

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = [None, "", " \n\t ", "x", "Ü ß　é", "a" * 5000, "one two three four", "|||", "new\nline\n\n", "word " * 3000]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))


def test_words_and_hashes_across_chunks():
    texts = [*_ODD, "same word", "WORD same"]
    whole = []
    for lo, hi, data, offsets in tb.text_chunks(pa.array(texts), 64):
        data = tb.lower(data)
        starts, ends, first = tb.words(data, offsets, tb.SPACE_SEPARATED)
        hashes = tb.span_hashes(data, starts, ends)
        for k in range(hi - lo):
            own = slice(first[k], first[k + 1])
            assert [bytes(data[a:b]).decode() for a, b in zip(starts[own], ends[own], strict=True)] == spaced(texts[lo + k])
            whole.append(hashes[own].tolist())
    assert whole[-1] == whole[-2][::-1]


def corpus(seed, n, size=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["w" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary, size)) for _ in range(n)], rng, vocabulary


def shingles(text):
    w = spaced(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(texts):
    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(spark):
    texts, rng, vocabulary = corpus(1, 25)
    for base in (texts[0], texts[1]):  # many copies with one to three words changed each
        for k in range(20):
            w = base.split(" ")
            for at in rng.integers(0, len(w), 1 + k % 3):
                w[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
    texts += [texts[0]] * 10 + _ODD
    found = {r["doc_id"]: r for r in hyperminhash.near_duplicates(frame(spark, texts)).collect()}
    for k, (n, component) in enumerate(linked(texts)):
        assert (found[k]["n_shingles"], found[k]["component_id"], found[k]["kept"]) == (n, component, k == component), k


def test_buckets_are_settled_when_centres_find_nothing(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "PIECE", 4)
    monkeypatch.setattr(hyperminhash, "_star_pairs", lambda members: members.select(F.col("cls").alias("a"), F.col("cls").alias("b")).where("false"))
    texts, rng, vocabulary = corpus(3, 3)
    for _ in range(12):
        w = texts[0].split(" ")
        w[rng.integers(0, len(w))] = str(rng.choice(vocabulary))
        texts.append(" ".join(w))
    found = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(frame(spark, texts)).collect()}
    expected = {k: component for k, (_, component) in enumerate(linked(texts))}
    assert found == expected
    assert len(set(expected.values())) < 6


def test_a_bucket_of_mutually_different_neighbours(spark):
    # a thousand texts share half of their words, so they meet in buckets, and few of them link
    texts, rng, vocabulary = corpus(11, 1, 100)
    head = texts[0]
    texts = [head + " " + " ".join(rng.choice(vocabulary, 60)) for _ in range(1000)]
    texts += [texts[k] + " more" for k in (7, 400, 401)] + [texts[900].rsplit(" ", 2)[0], head]
    found = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(frame(spark, texts)).collect()}
    assert found == {k: component for k, (_, component) in enumerate(linked(texts))}
    assert {found[1000], found[1001], found[1002], found[1003]} == {7, 400, 401, 900}


def test_near_copies_of_one_text_that_differ_by_degrees(spark):
    texts, rng, vocabulary = corpus(12, 1, 150)
    base = texts[0].split(" ")
    for k in range(300):
        w = list(base)
        for at in rng.integers(0, len(w), 1 + k % 12):
            w[at] = str(rng.choice(vocabulary))
        texts.append(" ".join(w))
    found = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(frame(spark, texts)).collect()}
    expected = {k: component for k, (_, component) in enumerate(linked(texts))}
    assert found == expected
    assert 20 < len(set(expected.values())) < 280


def test_rows_that_repeat_a_doc_id_link_by_their_own_texts(spark):
    one, two = corpus(13, 2)[0]
    rows = spark.createDataFrame([(1, one), (1, two), (2, two + " end"), (3, one + " end"), (4, None)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"]) for r in hyperminhash.near_duplicates(rows).collect())
    assert found == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_near_duplicates_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "A  b")], "doc_id long, text string")
    found = [tuple(r)[:4] for r in hyperminhash.near_duplicates(rows).orderBy("doc_id").collect()]
    assert found == [(None, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert hyperminhash.near_duplicates(rows.where("false")).count() == 0


def test_one_row_of_each_component_stays(spark):
    one, two = corpus(14, 2)[0]
    columns = ["doc_id", "text", "row", "Text_Hash", "component"]
    rows = [(1, one), (1, one), (1, two), (2, two + " end"), (3, one + " end"), (None, one), (4, None), (4, None), (5, " "), (6, "x")]
    docs = spark.createDataFrame([(*r, k % 3, None, "c") for k, r in enumerate(rows)], "doc_id long, text string, row int, Text_Hash string, component string")
    kept = hyperminhash.deduplicated(docs)
    assert kept.columns == columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")) for r in kept.collect()) == sorted([(1, one), (1, two), (0, one), (4, ""), (4, ""), (5, " "), (6, "x")])
    assert hyperminhash.deduplicated(docs.where("false")).count() == 0


def shuffled_bytes(spark, work):
    """Bytes that the stages of this work write for shuffles."""
    store = spark._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (lambda x: [x.apply(k) for k in range(x.size())])(store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None))}
    before = set(stages())
    work()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_texts_that_are_alone_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(21)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 1000)) for _ in range(400)]
    docs = frame(spark, texts + texts[:3])
    docs.write.parquet(str(tmp_path / "docs"))
    docs, out = spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "kept")
    moved = shuffled_bytes(spark, lambda: hyperminhash.deduplicated(docs).write.parquet(out))
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).select("doc_id").collect()) == list(range(400))
    assert moved < sum(map(len, texts)) / 3


@pytest.mark.parametrize("most", [1 << 13, 1 << 27])
def test_key_bits_lose_no_key(spark, monkeypatch, most):
    monkeypatch.setattr(keybits, "MOST_BITS", most)
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 3).alias("key"), F.lit("x").alias("chunk"))
    keys = rows.where("id % 20 < 1").select("key")
    bits = keybits.key_bits(written, keys, "key")
    found = keybits.possible(rows, bits, "key")
    assert found.columns == rows.columns
    ids = {r["id"] for r in found.collect()}
    assert ids >= set(range(0, 60_000, 20))
    assert most == 1 << 13 or len(ids - set(range(0, 60_000, 7))) < 3000 + 57_000 / 20
    nothing = keybits.key_bits(written, keys.where("false"), "key")
    assert keybits.possible(rows, nothing, "key").count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with Scratch(spark) as scratch:
        assert {r["label"] for r in hyperminhash.components(chain, scratch).collect()} == {0}


def test_jaccard_estimates(spark):
    texts, rng, _ = corpus(2, 1, 2000)
    words = texts[0].split(" ")
    data, offsets = tb.utf8(pa.array([" ".join(words), " ".join(words[:1800])]))
    codes, first, lost = hyperminhash.shingle_sets(data, offsets)
    registers = hyperminhash.sketches(codes, first, lost)
    share, _ = hyperminhash.estimate(registers[:1], registers[1:])
    assert abs(share[0] - 1796 / 1996) < 0.15
    assert (hyperminhash.bands(registers)[0] == hyperminhash.bands(registers)[1]).any()


def contaminated(text, items, width=13):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(_LOWER))
    hit, held = set(), set()
    for k, item in enumerate(items):
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (item or "").translate(_LOWER))
        for at in range(max(1, len(own) - width + 1) if own else 0):
            phrase = own[at : at + width]
            for p in range(len(w) - len(phrase) + 1):
                if w[p : p + len(phrase)] == phrase:
                    hit.update(range(p, p + len(phrase)))
                    held.add(str(k))
    return len(w), len(hit), sorted(held)


@pytest.mark.parametrize("block", [fm_index.MAX_PHRASE_BYTES, 400])
def test_contamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fm_index, "MAX_PHRASE_BYTES", block)
    texts, rng, _ = corpus(3, 12, 60)
    items = [" ".join(texts[0].split(" ")[5:30]), " ".join(texts[1].split(" ")[:13]), "wabc Wdef", "!!", None, "", "wabc"]
    texts += [texts[0].upper() + " wabc-wdef", "wabc wabc wabc", " ".join(texts[1].split(" ")[:12]), *_ODD]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in fm_index.verdicts(fm_index.contamination(docs, benchmark)).collect()}
    clean = {r["doc_id"] for r in fm_index.uncontaminated(docs, benchmark).collect()}
    for k, t in enumerate(texts):
        n, hit, held = contaminated(t, items)
        assert (found[k]["n_words"], found[k]["n_hit"], found[k]["items"]) == (n, hit, held), k
        assert (k in clean) == (not found[k]["contaminated"]) == (hit == 0 or 20 * hit < n)
    assert fm_index.contamination(docs, benchmark.where("false")).where("size(spans) > 0").count() == 0


@pytest.mark.parametrize("block", [fm_index.MAX_PHRASE_BYTES, 60])
def test_rows_are_cleaned_by_their_own_text(spark, monkeypatch, block):
    monkeypatch.setattr(fm_index, "MAX_PHRASE_BYTES", block)
    item = " ".join(f"w{k}" for k in range(20))
    benchmark = spark.createDataFrame([("a", item), ("a", item), ("b", "other words of a test"), ("c", None)], "item_id string, text string")
    rows = [(1, item + " dirty"), (1, "clean"), (None, item), (None, "clean too"), (2, None), (2, ""), (3, item), (3, item), (4, "long " * 50_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "_row": F.lit(2), "spans": F.lit("s")})
    kept = fm_index.uncontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == sorted([(1, 5), (0, 9), (2, 0), (2, 0), (4, 250_000 + len(item))])
    found = fm_index.verdicts(fm_index.contamination(docs, benchmark)).where("doc_id = 3").collect()
    assert [(r["n_items"], r["items"], r["contaminated"]) for r in found] == [(1, ["a"], True)] * 2
    assert fm_index.uncontaminated(docs.where("false"), benchmark).count() == 0
    assert fm_index.uncontaminated(docs, benchmark.where("false")).count() == len(rows)


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5, 3000)
    index = fm_index.FMIndex(text)
    phrases = [text[at : at + n] for at, n in ((3, 4), (100, 7), (2990, 10), (0, 1))] + [np.array([1, 9, 1])]
    which, where = index.search(fm_index.search_grid(phrases, np.array([len(p) for p in phrases]), 1))
    for k, p in enumerate(phrases):
        expected = [at for at in range(len(text) - len(p) + 1) if (text[at : at + len(p)] == p).all()]
        assert sorted(where[which == k].tolist()) == expected


_LINES = ["alpha beta gamma delta epsilon zeta eta", "a second line of some length, to be sure", "the third line stands here and is long too", "a fourth and last line with enough text"]


def test_later_copies_of_lines_go(spark):
    texts = ["\n".join(_LINES), "own opening line of the second text\n" + "\n".join(_LINES[1:3]) + "\nown end", "\n".join(_LINES), "short\nown", "short\nother", *_ODD]
    found = {r["doc_id"]: r for r in patience.dedup_lines(frame(spark, texts)).collect()}
    assert found[0]["text"] == texts[0]
    assert found[1]["text"] == "own opening line of the second text\nown end"
    assert [(b["start"], b["n"], b["partner"], b["partner_start"]) for b in found[1]["removed"]] == [(1, 2, 0, 1)]
    assert (found[2]["text"], found[2]["n_removed"]) == ("", 4)
    assert [found[k]["text"] for k in range(3, len(texts))] == texts[3:]
    assert patience.dedup_lines(frame(spark, texts).where("false")).count() == 0


def shared_stretches(texts, least):
    """Lines of each text in a stretch of that many bytes that an earlier text holds."""
    lines = [t.split("\n") for t in texts]
    gone = []
    for k, own in enumerate(lines):
        out = set()
        for other in lines[:k]:
            for a in range(len(own)):
                for c in range(len(other)):
                    n = 0
                    while a + n < len(own) and c + n < len(other) and own[a + n] == other[c + n]:
                        n += 1
                    if sum(len(x) for x in own[a : a + n]) >= least:
                        out |= set(range(a, a + n))
        gone.append(out)
    return gone


def test_every_stretch_that_an_earlier_text_holds_goes(spark):
    short = [f"{w} is a line" for w in ("one", "two", "three", "four", "five", "six")]
    # the lines of the copied text stand one by one, in another order or twice in earlier and later ones
    texts = ["\n".join(x) for x in ([short[1], _LINES[3], _LINES[1]], [short[4], "x"], short + _LINES, short + _LINES, [*_LINES[1:3], "own", *_LINES[1:3]], ["own", _LINES[3], _LINES[0]], ["a", *short[2:6], "b"])]
    rng = np.random.default_rng(7)
    for _ in range(25):
        texts.append("\n".join([f"only {len(texts)}", *[short[i] if i < 6 else _LINES[i - 6] if i < 9 else f"own {rng.integers(1000)}" for i in rng.integers(0, 12, 9)]]))
    found = {r["doc_id"]: r for r in patience.dedup_lines(frame(spark, texts), rare_share=1.0).collect()}
    for k, gone in enumerate(shared_stretches(texts, patience.LEAST_BYTES)):
        assert found[k]["text"] == "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in gone), k
        assert found[k]["n_removed"] == len(gone)
        for b in found[k]["removed"] or []:
            assert texts[k].split("\n")[b["start"] : b["start"] + b["n"]] == texts[b["partner"]].split("\n")[b["partner_start"] : b["partner_start"] + b["n"]]
    assert (found[3]["n_removed"], found[3]["text"]) == (10, "")


def test_blank_and_frequent_lines_go_with_rare_ones(spark):
    frequent = "a line that stands in most of the documents"
    items = [f"- item {k}" for k in range(8)]
    listed = "\n\n".join(items[:4]) + f"\n{frequent}\n" + "\n\n".join(items[4:])
    texts = [listed, "own\n" + listed + "\n\nend", *(f"other {k}\n{frequent}\n\n" for k in range(4)), listed]
    found = [r["text"] for r in patience.dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()]
    assert found == [listed, "own\n\nend", *texts[2:6], ""]


def test_rows_that_repeat_a_doc_id_are_cut_by_their_own_text(spark):
    rows = [(1, "\n".join(_LINES)), (2, "own\n" + _LINES[2]), (2, _LINES[1] + "\nother"), (2, _LINES[1] + "\nother")]
    found = patience.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare_share=1.0)
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == [(1, rows[0][1]), (2, "other"), (2, "other"), (2, "own")]


def test_patience_alignment():
    # of a b x c and a b y c, by places of the common lines
    assert patience.align([([0], [0]), ([1], [1]), ([3], [3])]) == [(0, 0), (1, 1), (3, 3)]
    # crossing lines: the longest run that increases in both stays
    assert patience.align([([0], [2]), ([1], [0]), ([2], [1])]) == [(1, 0), (2, 1)]
    # a repeated line is aligned next to others, or where it is unique in what is left
    assert patience.align([([0], [1]), ([1, 5], [2, 9])]) == [(0, 1), (1, 2), (5, 9)]


def test_language_by_code_length(spark):
    texts = ["the cat and the dog " * 3, "der hund und die katze " * 3] * 15
    rows = spark.createDataFrame([(k, t, ["en", "de"][k % 2]) for k, t in enumerate(texts)] + [(100, "x", None)], "doc_id long, text string, lang string")
    trees = ppm.fit(rows, train_docs=10)
    asked = frame(spark, ["the dog", "die katze und", None, "", "12 ... 34", "zzz"])
    found = [tuple(r) for r in ppm.predict(asked, trees).orderBy("doc_id").collect()]
    assert [f[1] for f in found[:5]] == ["en", "de", "und", "und", "und"]
    assert found[5][1] in ("en", "de") and all(0 <= f[2] <= 1 for f in found)
    assert {r["lang_pred"] for r in ppm.predict(asked, ppm.fit(rows.where("false"))).collect()} == {"und"}
    assert ppm.predict(asked.where("false"), trees).count() == 0
    long_ = frame(spark, ["die katze " * 30_000, "the dog", "the dog"]).withColumns({"score": F.lit(1), "lang_pred": F.lit("x")})
    again = [tuple(r) for r in ppm.predict(long_, trees).orderBy("doc_id").collect()]
    assert [r[1] for r in again] == ["de", "en", "en"] and again[1][1:] == again[2][1:]
    # a text that exceeds the bound teaches nothing, one within it does
    assert ppm.predict(asked.where("doc_id = 0"), ppm.fit(rows, train_bytes=70)).first()["lang_pred"] == "en"
    # languages that know the same tie, and the first by name is taken
    same = spark.createDataFrame([(0, "abc abc", "b"), (1, "abc abc", "a")], "doc_id long, text string, lang string")
    assert ppm.predict(asked.where("doc_id = 0"), ppm.fit(same)).first()["lang_pred"] == "a"


def test_code_lengths_match_a_plain_tree():
    sample = "abracadabra abra"
    code = lambda t, k: int.from_bytes(t.encode()[max(0, k - 4) : k + 1], "big")
    codes = [code(sample, k) for k in range(len(sample))]
    keys, n = np.unique(np.array(codes, np.uint64), return_counts=True)
    trees = ppm.ContextTrees(["x"], np.zeros(len(keys), np.int64), keys, n)
    seen = Counter()
    for k in range(len(sample)):
        for order in range(5):
            context = (b"\0" * 4 + sample.encode()[:k])[-order:] if order else b""
            seen[context, sample.encode()[k]] += 1

    def bits(text, k):
        total = 0.0
        for order in range(4, -1, -1):
            context = (b"\0" * 4 + text.encode()[:k])[-order:] if order else b""
            own = {s: c for (x, s), c in seen.items() if x == context}
            if own:
                symbol, base = text.encode()[k], sum(own.values()) + len(own)
                if symbol in own:
                    return total - math.log2(own[symbol] / base)
                total -= math.log2(len(own) / base)
        return total + 8

    for text in ("abracadabra", "bard", "zebra abra", ""):
        found, size = trees.code_lengths(pa.array([text]))
        assert size[0] == len(text)
        assert found[0, 0] == pytest.approx(sum(bits(text, k) for k in range(len(text))), rel=1e-5)


def test_language_model_scores(spark):
    texts = [*corpus(5, 30)[0], *_ODD, "never seen before"]
    docs = frame(spark, texts)
    learnt = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    keep = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    model = context_mixing.fit(docs.where(keep).select("text"))
    found = {r["doc_id"]: r for r in context_mixing.score(docs, model).collect()}
    counts = Counter(w for t in learnt for w in [*spaced(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        tokens = [*spaced(t), None]
        assert (found[k]["n_tokens"], found[k]["n_known"], found[k]["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert found[k]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens))
        assert found[k]["score"] < 0
    # text like the corpus costs fewer bits a byte than noise
    assert found[0]["score"] / len(texts[0]) > found[len(texts) - 1]["score"] / len(texts[-1])
    none = context_mixing.fit(docs.where("false").select("text"))
    blank = context_mixing.score(docs.where("doc_id = 31"), none).first()
    assert (blank["base_score"], blank["train_tokens"]) == (0.0, 0)
    assert blank["score"] == pytest.approx(-8 * math.log10(2), rel=1e-3)


def test_scores_do_not_depend_on_how_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "RANGE_BYTES", 2000)
    docs = frame(spark, corpus(15, 60, 60)[0] + _ODD + ["same"] * 5).withColumn("extra", F.lit(1))
    found = []
    for parts in (1, 7):
        dealt = docs.repartition(parts, "text")
        found.append({r["doc_id"]: (r["base_score"], r["score"]) for r in context_mixing.score(dealt, context_mixing.fit(dealt.select("text"))).collect()})
    assert found[0].keys() == found[1].keys()
    for k, pair in found[0].items():
        assert pair == pytest.approx(found[1][k], rel=1e-9), k
    assert len({found[0][len(found[0]) - 1 - k] for k in range(5)}) == 1
    assert context_mixing.score(docs.where("false"), context_mixing.fit(docs.select("text"))).count() == 0


def test_the_mixer_beats_its_parts_on_held_out_text(spark):
    texts, rng, vocabulary = corpus(16, 120, 100)
    docs = frame(spark, texts)
    model = context_mixing.fit(docs.where("doc_id < 90").select("text"))
    held = context_mixing.score(docs.where("doc_id >= 90"), model).agg(F.sum("score"), F.sum("base_score")).first()
    # the base does not code the white space, nor which unknown word stands there
    assert held[0] > 1.2 * held[1]
    letters = Counter(c for t in texts[:90] for c in t + "\xff")
    plain = sum(math.log10(letters[c] / sum(letters.values())) for t in texts[90:] for c in t + "\xff")
    assert held[0] > 0.7 * plain


def test_tables_grow_with_the_codes():
    sizes = [sum(1 << b for b in context_mixing.table_bits(n)) for n in (0, 1 << 20, 1 << 21, 1 << 40)]
    assert sizes[0] == sizes[1] < sizes[2] < sizes[3] <= 5 << context_mixing.MOST_BITS


def test_what_a_pricer_keeps_changes_no_cost():
    data = pa.array(corpus(6, 5)[0])
    codes = np.concatenate([c for _, _, c in context_mixing.coded(*context_mixing.closed(data))])
    counts = np.zeros((sum(1 << b for b in context_mixing.TABLE_BITS), 2), np.int64)
    keys, n = np.unique(codes, return_counts=True)
    context_mixing.table_counts(keys, n, counts)
    mixer = context_mixing.Mixer(context_mixing.packed(counts))
    mixer.set_map(np.zeros((2, 256 * context_mixing.BINS)))
    pricer = context_mixing.Pricer(mixer.freeze())
    again = [pricer.cost(codes) for _ in range(2)]
    assert (again[0] == again[1]).all() and np.allclose(again[0], mixer.cost(codes))


def test_quality_model_learns(spark):
    texts = ["Some plain words that stand in order here. " * 12, "$$$ ### !!! @@@ %%% &&& " * 20] * 30
    docs = frame(spark, [*texts, *_ODD])
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)] + [(41, None)], "doc_id long, quality int")
    model = attention_mil.fit(docs, labels)
    scores = [r["score"] for r in attention_mil.score(docs, model).orderBy("doc_id").collect()]
    assert min(scores[40:60:2]) > 0.7 > max(scores[41:60:2])
    assert all(0 <= s <= 1 for s in scores)
    wider = docs.select("*", F.lit(1).alias("score"), F.lit(2).alias("label"))
    kept = attention_mil.accepted(wider, model)
    assert kept.columns == wider.columns and kept.where("doc_id < 60 and doc_id % 2 = 1").count() == 0
    assert attention_mil.score(docs, attention_mil.fit(docs, labels.where("false"))).first()["score"] == 0.5
    assert attention_mil.score(docs.where("false"), model).count() == 0
    assert attention_mil.score(docs, attention_mil.fit(docs, labels, train_bytes=1)).first()["score"] == 0.5
    # of several labels of a document the smallest counts; repeated rows are judged alike
    twice = labels.union(labels.where("quality = 0").withColumn("quality", F.lit(1)))
    assert [r["score"] for r in attention_mil.score(docs, attention_mil.fit(docs, twice)).orderBy("doc_id").collect()] == pytest.approx(scores)
    rows = frame(spark, [texts[0], texts[0]] + ["word " * 100_000])
    found = [r["score"] for r in attention_mil.score(rows, model).orderBy("doc_id").collect()]
    assert found[0] == found[1] and 0 <= found[2] <= 1


def test_gradients_of_the_quality_model():
    rng = np.random.default_rng(7)
    x, base, labels = rng.standard_normal((9, attention_mil.FEATURES)).astype(np.float32), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = attention_mil.AttentionMIL()
    model.fit(x, base, labels)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = model._scaled(x).astype(np.float64)

    def loss():
        p = model._forward(x, base)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = model._gradients(x, base, labels)
    for name, at in (("W", (3, 2)), ("b", (1,)), ("V", (2, 3)), ("U", (4, 1)), ("w", (5,)), ("c", (6,)), ("d", (0,))):
        kept = model.weights[name][at]
        model.weights[name][at] = kept + 1e-5
        up = loss()
        model.weights[name][at] = kept - 1e-5
        assert grads[name][at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-7)
        model.weights[name][at] = kept
