"""Operators on texts against brute force, with the cases that real tables bring along."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cardwatch.llm import decontam, langid, licenses, lmscore, neardup, packing, sharding, simhash
from cardwatch.llm.word_cache import WordTokenizer

WORDS = "the of and licence dog house running tree water apache license cc by mit blue sky".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [sentence(rng, rng.randint(1, 60)) for _ in range(40)]
    return [*made, None, "", " \n\t", made[0], made[0], "Zürich " * 30_000, "a\x00b", "é" * 5]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns whose names the operators use themselves; one NULL id, one repeated row."""
    rows = [(k, t, "x", 1, "y", 2.0) for k, t in enumerate(texts)]
    rows += [(None, "the dog of the house", None, None, None, None), rows[3]]
    schema = "doc_id long, text string, label string, row_id int, shard string, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


# --- packing -----------------------------------------------------------------------------------


def test_word_cache_equals_whole_texts():
    tokenizer = WordTokenizer(packing.vocabulary_file())
    assert tokenizer.by_word
    rng = random.Random(1)
    alphabet = list("aAbÉéßİΣς'stredllm 0123٣½²\t\n\x0b\x1c\x85\xa0 ​̧́ñ中🙂<|>endoftext,.-$\x01")
    samples = ["".join(rng.choices(alphabet, k=rng.randint(0, 16))) for _ in range(3000)]
    for text in [*samples, "Don't stop, it's.'s ,'re", "<|endoftext|> a", "Hello, world. Hello"]:
        whole = tokenizer.whole.encode(text, add_special_tokens=False).ids
        assert tokenizer.encode(text) == np.asarray(whole, "<u4").tobytes(), text


def test_packing_is_complete_and_gapless(docs, texts):
    placed = packing.pack_documents(docs, packing.vocabulary_file(), capacity=64).collect()
    whole = WordTokenizer(packing.vocabulary_file()).whole
    pieces = {}
    for row in placed:
        pieces.setdefault(row["doc_id"], []).append(row)
    for k, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        copies = 2 if k == 3 else 1
        own = sorted(pieces[k], key=lambda r: r["piece"])[::copies]
        assert [r["start"] for r in own] == list(range(0, len(ids), 64))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] <= 64 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert None in pieces
    filled = {}
    for row in placed:
        filled.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= 1.05 * -(-sum(r["length"] for r in placed) // 64) + 1


def test_packing_by_the_sum_of_squares():
    """Each placement is among those with the smallest sum of squares of open bins per gap."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 13, 300)
    bins, offsets = packing.sum_of_squares(sizes, 12)
    level: dict[int, int] = {}
    for size, chosen, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        assert level.get(chosen, 0) == offset

        def squares(levels):
            gaps = [12 - v for v in levels.values() if v < 12]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = [squares(level | {b: v + size}) for b, v in level.items() if v + size <= 12]
        options.append(squares(level | {len(level): size}))
        level[chosen] = offset + size
        assert squares(level) == min(options)


def test_sequences_hold_the_ids(docs):
    placed = packing.pack_documents(docs, packing.vocabulary_file(), capacity=64, with_ids=True)
    for row in packing.sequences(placed).collect():
        assert len(row["input_ids"]) <= 64 and row["input_ids"][-1] is not None
        assert row["offsets"] == sorted(row["offsets"])


def test_packing_of_nothing(none):
    assert packing.pack_documents(none, packing.vocabulary_file()).collect() == []


# --- sharding ----------------------------------------------------------------------------------


def jump(key: int, shards: int) -> int:
    key %= 2**64
    shard, following = -1, 0
    while following < shards:
        shard = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


def test_jump_hash_equals_the_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(3).randrange(-(2**63), 2**63) for _ in range(200))]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    for shards in (1, 2, 24, 25, 100):
        for row in sharding.with_shard(frame, "key", shards).collect():
            assert row["shard"] == jump(row["key"], shards)


@pytest.mark.parametrize("bucket_rows", [1, 50_000])
def test_slots_are_gapless(docs, texts, bucket_rows):
    rows = sharding.sharded_digest(docs, 5, bucket_rows).collect()
    assert len(rows) == len(texts) + 2
    slots = {}
    for row in rows:
        slots.setdefault(row["shard"], []).append(row["slot"])
        key = -1 if row["doc_id"] is None else row["doc_id"]
        assert row["shard"] == jump(key, 5) and row["grown_shard"] in (row["shard"], 5)
        if row["doc_id"] is not None:
            data = (texts[row["doc_id"]] or "").encode()
            assert row["size"] == len(data) + 8 and row["text_crc32"] == zlib.crc32(data)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_sharding_of_strings_and_nothing(spark, none):
    frame = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, shard int")
    assert {row["shard"] for row in sharding.with_shard(frame, "name", 3).collect()} <= {0, 1, 2}
    assert sharding.sharded_digest(none, 5).collect() == []


# --- SimHash -----------------------------------------------------------------------------------


def plain_print(text: str | None, words: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    ones = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def components(prints: list[int], radius: int) -> dict[int, int]:
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in distinct}


def test_fingerprints_and_components(docs, texts):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect() if r["doc_id"] is not None}
    prints = [plain_print(t) for t in texts]
    groups = components(prints, 3)
    smallest = {}
    for k, p in enumerate(prints):
        smallest.setdefault(groups[p], k)
    for k, p in enumerate(prints):
        assert got[k]["print"] % 2**64 == p and got[k]["component_id"] == smallest[groups[p]]


@pytest.mark.parametrize("cell", [2048, 3])
def test_covering_tables_lose_no_link(spark, cell):
    rng = random.Random(9)
    prints = set()
    for _ in range(15):
        near = rng.randrange(-(2**63), 2**63)
        for _ in range(60):
            for bit in rng.sample(range(63), rng.randint(0, 3)):
                near ^= 1 << bit
            prints.add(near)
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    found = simhash.links(frame, 3, cell).select(F.col("print").alias("a"), F.col("least").alias("b"))
    roots = dict(simhash.least_reachable(found).collect())
    wanted = components(list(prints), 3)
    assert all(roots.get(p, p) == wanted[p] for p in prints)


def test_every_three_positions_are_left_out_by_some_mask():
    from itertools import combinations

    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    assert all(any(not any(m >> p & 1 for p in three) for m in masks) for three in combinations(range(64), 3))


def test_one_document_of_each_group_stays(docs, texts):
    kept = [r["doc_id"] for r in simhash.near_duplicates_removed(docs).collect()]
    wanted = {r["component_id"] for r in simhash.simhash_groups(docs.filter("doc_id IS NOT NULL")).collect()}
    assert kept.count(None) == 1 and sorted(k for k in kept if k is not None) == sorted(wanted)


def test_simhash_of_nothing(none):
    assert simhash.simhash_groups(none).collect() == []
    assert simhash.near_duplicates_removed(none).columns == none.columns


# --- decontamination ---------------------------------------------------------------------------


def distance(pattern: list[str], text: list[str]) -> int:
    before = [0] * (len(text) + 1)
    for i, word in enumerate(pattern, 1):
        now = [i] + [0] * len(text)
        for j, other in enumerate(text, 1):
            now[j] = min(before[j - 1] + (word != other), before[j] + 1, now[j - 1] + 1)
        before = now
    return min(before)


def test_pigeonhole_finds_what_brute_force_finds():
    rng = random.Random(4)
    for _ in range(300):
        words = [f"w{k}" for k in range(rng.choice((3, 60)))]
        item = rng.choices(words, k=rng.randint(decontam.MIN_WORDS, 70))
        text = rng.choices(words, k=rng.randint(0, 60))
        if rng.random() < 0.7:
            copied = [w for w in item if rng.random() > 0.06]
            at = rng.randint(0, len(text))
            text = text[:at] + copied + text[at:]
        starts = decontam.window_starts(len(item))
        windows = [item if s is None else item[s : s + decontam.WINDOW] for s in starts]
        near = [d for w in windows if (d := distance(w, text)) <= len(w) // decontam.WORDS_PER_EDIT]
        found = decontam.Finder([(1, " ".join(item))]).search(" ".join(text))
        assert [(f[2], f[3]) for f in found] == ([(len(near), min(near))] if near else [])


def test_every_excerpt_of_a_window_is_found():
    rng = random.Random(6)
    around = [f"x{k}" for k in range(40)]
    for length in (24, 25, 29, 36, 37, 49, 60):
        item = [f"w{k}" for k in range(length)]
        finder = decontam.Finder([(1, " ".join(item))])
        assert finder.search(" ".join(around)) == []
        for start in range(length - decontam.WINDOW + 1):
            for end in range(start + decontam.WINDOW, length + 1):
                part = item[start:end]
                assert finder.search(" ".join([*around, *part, *around]))[0][3] == 0
                for place in rng.sample(range(len(part)), 3):
                    part[place] = "edited"
                assert finder.search(" ".join([*around, *part, *around]))[0][3] <= 3
        short = " ".join([*around, *item[:15], *around])
        assert finder.search(short) == []


def test_decontamination(spark, docs, texts):
    rng = random.Random(8)
    leak = " ".join(f"leak{k}" for k in range(30))
    changed = leak.replace("leak4 ", "other ").upper()
    rows = [(1000, f"{sentence(rng, 20)} {leak}, {sentence(rng, 9)}"), (1001, f"x {changed}."), (1002, leak[:20])]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = [(7, leak), (7, leak), (8, None), (9, ""), (10, "the of"), (None, " ".join(f"n{k}" for k in range(9)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.matches(more, bench).collect()}
    assert set(found) == {(1000, 7), (1001, 7)}
    assert (found[1000, 7]["first_word"], found[1000, 7]["last_word"], found[1000, 7]["distance"]) == (20, 49, 0)
    assert found[1001, 7]["distance"] == 1
    kept = decontam.decontaminated(more, bench)
    assert kept.count() == more.count() - 2 and kept.columns == more.columns
    assert decontam.matches(docs, bench.filter("false")).count() == 0
    assert decontam.decontaminated(docs.filter("false"), bench).count() == 0


def test_an_item_of_two_texts_is_one_in_every_block(spark, monkeypatch):
    texts = [" ".join(f"t{t}w{j}" for j in range(26)) for t in range(2)]
    items = spark.createDataFrame([(7, texts[0]), (7, texts[1])] + [(k, f"other item {k} of six words") for k in range(20)], "item_id long, text string")
    more = spark.createDataFrame([(1, f"{texts[0]} and {texts[1]}")], "doc_id long, text string")
    whole = [tuple(r) for r in decontam.matches(more, items).collect()]
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert [tuple(r) for r in decontam.matches(more, items).collect()] == whole and len(whole) == 1


def test_benchmark_blocks_change_nothing(spark, docs, monkeypatch):
    items = [(k, " ".join(f"b{k}w{j}" for j in range(20))) for k in range(10)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(items, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    assert decontam.matches(more, bench).count() == 10
    assert decontam.decontaminated(more, bench).count() == docs.count()


# --- licenses ----------------------------------------------------------------------------------


def test_license_blocks_equal_brute_force():
    rng = random.Random(6)
    wanted = licenses.templates()
    vocabulary = sorted({w for t in wanted for w in t.phrase}) + WORDS
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        if rng.random() < 0.6:
            template = rng.choice(wanted)
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in template.phrase if rng.random() > 0.1]
        often = {w: rng.randint(0, 9) for w in vocabulary}
        found = {(t.phrase, start) for t, start, _, _ in licenses.Scanner(wanted, often).blocks(words)}
        brute = set()
        for t in wanted:
            step = len(t.phrase)
            for start in range(0, len(words), step):
                if len(set(words[start : start + 2 * step]) & set(t.phrase)) >= t.need:
                    brute.add((t.phrase, start))
        assert found == brute


def test_license_places(spark, none):
    rows = [(1, "Under the\nMIT License. mit license"), (2, None), (3, "GNU General Public License, version 3"), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scanned(frame).collect()}
    assert [(p["word"], p["label"]) for p in got[1]["places"]] == [(2, "mit"), (4, "mit")]
    assert got[2]["n_words"] == 0 and got[2]["score"] == 0.0 and got[3]["labels"] == ["gpl-3"]
    assert licenses.scanned(none).collect() == []


# --- language ----------------------------------------------------------------------------------


def language_rows(n: int) -> list[tuple]:
    rng = random.Random(12)
    spoken = {"en": "the and that with have this from they".split(), "de": "der und nicht mit auch über für schön".split()}
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(spoken))
        rows.append((k, " ".join(rng.choices(spoken[lang], k=rng.randint(3, 40))), lang))
    return rows


def test_language_is_learned(spark):
    rows = language_rows(240)
    extra = [(900, None, "en"), (901, "123 ! ½ ²", "de"), (902, "the and that", None), (None, "nicht mit", "de")]
    frame = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identified(frame).collect()}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k, *_ in rows if got[k]["held_out"]} == set(held)
    right = sum(got[k]["lang_pred"] == rows[k][2] for k in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"


def test_language_is_learned_from_rows_without_id(spark):
    rows = [(None, text, lang) for _, text, lang in language_rows(200)] * 2
    frame = spark.createDataFrame(rows + [(1, "the and that with", None)], "doc_id long, text string, lang string")
    got = langid.identified(frame).filter("doc_id = 1").first()
    assert got["lang_pred"] == "en"


def test_sample_is_bounded_and_even(spark):
    rows = [(k, f"text {k}", "en") for k in range(5000)] + [(k, f"text {k}", "de") for k in range(40)] + [(1, "same", "fr")] * 3000
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang"]: r["count"] for r in langid.sample(frame, 600).groupBy("lang").count().collect()}
    assert got == {"en": 200, "de": 40, "fr": 1}


def test_language_without_anything_to_learn(spark):
    frame = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identified(frame).collect()] == [("und", 0.0)]
    assert langid.identified(frame.filter("false")).collect() == []


def test_ngram_counts_do_not_depend_on_the_chunk(monkeypatch):
    text = "Grüße aus dem Süden, 中文 🙂 " * 40
    whole = langid.ngram_counts(text), sum(lmscore.tokens(text), [])
    monkeypatch.setattr(langid, "CHUNK", 7)
    monkeypatch.setattr(lmscore, "CHUNK", 7)
    assert (langid.ngram_counts(text) == whole[0]).all()
    assert sum(lmscore.tokens(text), []) == whole[1]
    assert whole[1][:8] == ["grüße", "aus", "dem", "süden", ",", "中", "文", "🙂"]


# --- language model ----------------------------------------------------------------------------


def plain_losses(texts: list[str]):
    from collections import Counter

    def words(text):
        return re.findall(r"[一-鿿]|[^\W一-鿿]+|[^\w\s]", text.lower())

    ones, twos = Counter(), Counter()
    for text in texts:
        if words(text):
            found = ["", *words(text), ""]
            ones.update(found[1:])
            twos.update(zip(found, found[1:], strict=False))

    def loss(text):
        found = ["", *words(text), ""]
        out = []
        for before, word in zip(found, found[1:], strict=False):
            chance = 64.0 ** -(min(len(word), 100) + 1)
            chance = (ones[word] + 20 * chance) / (sum(ones.values()) + 20)
            out.append(-np.log((twos[before, word] + 20 * chance) / (ones[before] + 20)))
        return out

    return loss


@pytest.mark.parametrize("block_rows", [50_000, 2])
def test_cross_entropy_difference_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(lmscore, "BLOCK_ROWS", block_rows)
    texts = ["the dog runs.", "A dog, a DOG!", "xx yy 12", "", None, "été\nzz", " \n", "中文 " + "w" * 300, "the dog runs.", "Чёрный кот, the dog"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    target, background = plain_losses(texts[:2]), plain_losses([t or "" for t in texts])
    rows = lmscore.scored(frame, labels).collect()
    assert sorted(row["doc_id"] for row in rows) == list(range(len(texts)))
    for row in rows:
        text = (texts[row["doc_id"]] or "").strip()
        if text:
            assert row["tokens"] == len(target(text))
            assert row["loss_target"] == pytest.approx(np.mean(target(text)), rel=1e-9)
            assert row["loss_background"] == pytest.approx(np.mean(background(text)), rel=1e-9)
        else:
            assert (row["tokens"], row["loss_target"], row["score"]) == (0, 0.0, 0.0)
        assert row["score"] == pytest.approx(row["loss_target"] - row["loss_background"], abs=1e-9)
    assert lmscore.scored(frame.filter("false"), labels).collect() == []
    assert lmscore.scored(frame, labels.filter("false")).count() == len(texts)


def test_repeated_ids_and_copies_are_scored_each(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_ROWS", 20)
    rows = [(7, "one and the same text")] * 60 + [(7, "another")] + [(None, "no id")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))
    labels = spark.createDataFrame([(7, 1), (7, 2)], "doc_id long, quality int")
    found = lmscore.scored(frame, labels).collect()
    target = plain_losses([text for doc_id, text in rows if doc_id == 7])
    assert len(found) == len(rows)
    assert len({(r["doc_id"], r["tokens"], r["score"]) for r in found}) == 3
    (loss,) = {r["loss_target"] for r in found if r["doc_id"] is None}
    assert loss == pytest.approx(np.mean(target("no id")), rel=1e-9)


def test_a_block_sends_its_counts_in_few_bytes():
    """Rows and bytes of what a block sends, and that the sums are those of all blocks."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(400)) for _ in range(100)]
    blocks = [pa.table({"block": [k] * 50, "doc_id": list(range(50 * k, 50 * k + 50)), "text": texts[50 * k : 50 * k + 50]}) for k in range(2)]
    good = pa.table({"place": [0, 1], "good": [7, 60]})
    sent = pa.concat_tables([lmscore.count_block(docs, good, 3) for docs in blocks])
    n = sum(sent["length"].to_pylist())
    assert sent.num_rows == 6 and n == sum(len(lmscore.Block(docs.to_batches()).grams) for docs in blocks)
    assert sum(len(d) for name in ("grams", "n", "n_good") for d in sent[name].to_pylist()) < 8 * n
    sums = pa.concat_tables([lmscore.sum_span(sent.filter(pa.compute.equal(sent["span"], k))) for k in range(3)])
    target, background = plain_losses([texts[7], texts[60]]), plain_losses(texts)
    for k, docs in enumerate(blocks):
        for row in lmscore.score_block(docs, sums.filter(pa.compute.equal(sums["block"], k)), 3).to_pylist():
            assert row["loss_target"] == pytest.approx(np.mean(target(texts[row["doc_id"]])), rel=1e-9)
            assert row["loss_background"] == pytest.approx(np.mean(background(texts[row["doc_id"]])), rel=1e-9)


# --- near duplicates of the pipeline -------------------------------------------------------------


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("cell", [2048, 3])
def test_near_duplicates_of_each_group_but_one_go(spark, cell, monkeypatch):
    """Every pair by brute force: what goes has a partner, and of each group found one row stays."""
    monkeypatch.setattr(neardup, "CELL", cell)
    rng = random.Random(14)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 220))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            texts.append(" ".join(edited(rng, base, rng.randint(1, max(1, len(base) // 50)))))
    rng.shuffle(texts)
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    got = {r["doc_id"] for r in neardup.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string, digest string, goes int").repartition(3)).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    wanted = {k for k in range(len(texts)) if find(k) == k}
    assert wanted <= got and len(got - wanted) <= 0.1 * (len(texts) - len(wanted))


def test_near_duplicates_by_row(spark):
    long = " ".join(f"a{k}" for k in range(100))
    rows = [
        (5, long, "p"), (5, "another text of six words", "q"), (None, long, "r"), (None, "nothing else is like this one", "s"),
        (None, "nothing else is like this one", "t"), (3, long + " end", "u"), (8, None, "v"), (9, "", "w"), (9, " \n", "x"), (7, "one", "y"),
        (7, "one", "y"), (6, "ONE", "z"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(2)
    out = neardup.near_duplicates_removed(frame)
    assert out.schema == frame.schema
    got = [(r["doc_id"], r["root"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(3, "u"), (5, "q"), (None, got[[g[0] for g in got].index(None)][1]), (8, "v"), (6, "z")], key=str)
    assert neardup.near_duplicates_removed(frame.filter("false")).collect() == []


@pytest.mark.parametrize("cell", [None, 3])
def test_pairs_within_the_radius_are_linked_without_equal_min_hashes(spark, cell):
    """Covering masks alone find every pair within the radius that is alike, and nothing else is linked."""
    rng = random.Random(21)
    rows = []
    for group in range(30):
        print_, sketch = rng.getrandbits(64), rng.sample(range(10**6), 100)
        for _ in range(8 if group else 40):
            flipped = print_
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                flipped ^= 1 << bit
            own = sorted(rng.sample(sketch, 95) + rng.sample(range(10**6), rng.choice([2, 60])))
            rows.append((len(rows), flipped, own))
    signed = [(k, p - (p >> 63 << 64), [4 * k + n for n in range(neardup.TABLES)], s) for k, p, s in rows]
    classes = spark.createDataFrame(signed, "node long, print long, mins array<long>, sketch array<int>").repartition(3)

    def components(pairs):
        of = list(range(len(rows)))
        for a, b in pairs:
            low, high = sorted((of[a], of[b]))
            of = [low if x == high else x for x in of]
        return of

    wanted = components(
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if (rows[a][1] ^ rows[b][1]).bit_count() <= neardup.RADIUS and neardup.alike(np.array(rows[a][2]), np.array(rows[b][2])) >= 0.8
    )
    found = [tuple(r) for r in neardup.verified_links(classes, cell=cell).collect()]
    assert len(set(wanted)) < len(rows)
    assert components(found) == wanted


def test_similarity_of_sketches():
    rng = random.Random(3)
    for size in (1, 4, 30, 200, 2000):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        other = edited(rng, words, max(1, size // 60))
        a, b = (neardup.sketch(" ".join(w)) for w in (words, other))
        found = neardup.alike(np.array(a[2]), np.array(b[2]))
        assert abs(found - jaccard(" ".join(words), " ".join(other))) < (1e-9 if size < 250 else 0.12)
    assert neardup.sketch(None) == neardup.sketch("") == neardup.sketch(" ")
