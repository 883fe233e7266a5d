"""Toxicity, pseudonyms, top-k search and the pipeline against brute force and planted cases."""

import hashlib
import math
import random
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardwatch.llm import deobfuscation, pii, topk, toxicity

CLEAN = "the house and the water of a running dog stands near some tall trees while people walk".split()
TOXIC = ["gromble", "snarfix", "plunkard"]


def plain_text(rng: random.Random, n: int) -> list[str]:
    return rng.choices(CLEAN, k=n)


# --- toxicity ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(21)
    rows, labels = [], []
    for k in range(400):
        words = plain_text(rng, rng.randint(5, 50)) + [f"w{rng.randint(0, 5000)}"]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(TOXIC))
        rows.append((k, " ".join(words), "en", 1.0))
        if k % 10 != 3:
            labels.append((k, 1, int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", 1.0), (None, "a gromble", "en", 1.0), (1002, "x " * 60_000, "en", 1.0)]
    labels += [(0, 1, None), (None, 1, 1), (5, 0, 0), (7, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string, label double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    docs, labels = labelled
    return toxicity.trained(docs, toxicity.learnable(labels))


def test_held_out_toxicity(labelled, model):
    docs, _ = labelled
    scores = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    for k in range(400):
        assert (scores[k] >= toxicity.THRESHOLD) == (k % 5 == 0), k
    assert scores[1000] == scores[1001] < toxicity.THRESHOLD and scores[None] >= toxicity.THRESHOLD
    assert all(0 <= s <= 1 for s in scores.values())


@pytest.mark.parametrize(
    "disguised",
    ["gr0mble", "GROMBL3", "snarf1x", "$narfix", "p l u n k a r d", "g.r.o.m.b.l.e", "s-n-a-r-f-i-x", "gr0mbl3",
     "grooooomble", "pluuunkaaard", "gro​mble", "p1unk@rd", "G R 0 M B L E", "ggrroommbbllee",
     "grom-ble", "snar.fix", "plun_kard", "ｇｒｏｍｂｌｅ", "grоmblе", "g\u0336r\u0336o\u0336m\u0336b\u0336l\u0336e\u0336"],
)
def test_disguise_is_undone(model, disguised):
    assert model.score(f"the house of a {disguised} near some trees") >= toxicity.THRESHOLD
    assert model.score("the house of a 4 story building, near 12 trees at 10 p m") < toxicity.THRESHOLD


@pytest.mark.parametrize("disguised", ["gr0mble", "grooooomble", "pluuunkaaard", "ggrroommbbllee", "p l u n k a r d", "grom-ble"])
@pytest.mark.parametrize("after", [", and 20 trees", " and 20 trees", "!", "!!1", "+", "? 1 $"])
def test_disguise_is_undone_before_digits_and_signs(model, disguised, after):
    assert model.score(f"the house of a {disguised}{after}") >= toxicity.THRESHOLD
    assert model.score(f"the house of a doooog{after}") < toxicity.THRESHOLD


@pytest.mark.parametrize("text", ["a.b" * 60_000, "a b " * 60_000, "x1" * 60_000, "ab" * 60_000 + " а", "aaa " * 60_000, "1a " * 60_000])
def test_long_texts_take_linear_time(model, text):
    import time

    start = time.process_time()
    model.score(text)
    assert time.process_time() - start < 20


def test_viterbi_finds_the_cheapest_path():
    rng = random.Random(3)
    counts = np.array([rng.randint(0, 9) for _ in range(deobfuscation.SYMBOLS**3)], float)
    restorer = deobfuscation.Restorer(counts)
    from itertools import product

    for _ in range(40):
        stretch = "".join(rng.choices("a1$eoo0bz", k=rng.randint(1, 6)))
        costs = {}
        for path in product(*deobfuscation.lattice(stretch)):
            word = "".join(letters for letters, _ in path)
            symbols = [0, 0, *map(deobfuscation.symbol, word), 0]
            total = sum(cost for _, cost in path)
            total += sum(restorer.cost[a][b][c] for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
            costs[word] = min(total, costs.get(word, math.inf))
        assert costs[restorer.decode(stretch)] == pytest.approx(min(costs.values()))


def test_toxic_rows_go(labelled, model):
    docs, _ = labelled
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {k for k in range(400) if k % 5} | {1000, 1001, 1002}


def test_toxicity_without_labels_or_rows(labelled):
    docs, labels = labelled
    for known in (labels.filter("false"), labels.filter("toxic = 0")):
        none = toxicity.trained(docs, known)
        assert {r["score"] for r in toxicity.scores(docs, none).collect()} == {0.0}
    empty = toxicity.trained(docs.filter("false"), labels)
    assert toxicity.scores(docs.filter("false"), empty).collect() == []


# --- pseudonyms --------------------------------------------------------------------------------


def keyed(kind: str, *parts) -> int:
    told = "|".join([pii.DEMO_KEY, kind, *map(str, parts)])
    return int(hashlib.sha256(told.encode()).hexdigest()[:15], 16)


def plain_pair(left: int, right: int, a: int, b: int, kind: str) -> tuple[int, int]:
    for turn in range(1, pii.ROUNDS + 1):
        left = (left + keyed(f"{kind} left", turn, a, b, right)) % a
        right = (right + keyed(f"{kind} right", turn, a, b, left)) % b
    return left, right


def plain_string(value: str, kind: str, *also: str) -> str:
    left, right = value[: len(value) // 2], value[len(value) // 2 :]

    def shifted(own: str, other: str, turn: int, side: str) -> str:
        out = []
        for place, c in enumerate(own):
            base, radix = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            by = keyed(f"{kind} {side}", turn, len(value), place, other, *also)
            out.append(chr((ord(c) - base + by % radix) % radix + base))
        return "".join(out)

    for turn in range(1, pii.ROUNDS + 1):
        left = shifted(left, right, turn, "left")
        right = shifted(right, left, turn, "right")
    return left + right


def luhn(digits: str) -> int:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10


def card(rng: random.Random, size: int) -> str:
    start = "4" + "".join(rng.choices("0123456789", k=size - 2))
    return next(start + d for d in "0123456789" if luhn(start + d) == 0)


def pseudonyms(spark, texts: list[str]) -> list[str]:
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymized(frame).orderBy("doc_id").collect()]


def test_cards_keep_form_and_check_digit(spark):
    rng = random.Random(1)
    cards = [card(rng, size) for size in (13, 15, 16, 16, 19) for _ in range(8)]
    new = pseudonyms(spark, cards)
    assert len(set(new)) == len(set(cards))
    for old, made in zip(cards, new, strict=True):
        inner = plain_string(old[1:-1], "card")
        assert made[:-1] == old[0] + inner and luhn(made) == 0 and len(made) == len(old)
    grouped = " ".join(cards[16][k : k + 4] for k in range(0, 16, 4))
    again = pseudonyms(spark, [f"<{cards[16]}> and {grouped}; not {cards[16][:-1]}{(int(cards[16][-1]) + 1) % 10}"])[0]
    first, second = re.match(r"<(\d+)> and ([\d ]+);", again).groups()
    assert first == second.replace(" ", "") == new[16]
    assert again.endswith(f"not {cards[16][:-1]}{(int(cards[16][-1]) + 1) % 10}")


def test_addresses_phones_and_security_numbers(spark):
    rng = random.Random(2)
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(30)]
    for old, made in zip(ips, pseudonyms(spark, ips), strict=True):
        a, b, c, d = map(int, old.split("."))
        left, right = plain_pair(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
        assert made == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    phones = [f"+1 ({rng.randint(0, 999):03}) {rng.randint(0, 999):03}-{rng.randint(0, 9999):04}" for _ in range(30)]
    for old, made in zip(phones, pseudonyms(spark, phones), strict=True):
        assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", made) and made != old
        assert (old[4] in "01") == (made[4] in "01") and (old[9] in "01") == (made[9] in "01")
    numbers = [f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(30)]
    made = pseudonyms(spark, numbers)
    assert len(set(made)) == len(set(numbers))
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", m) for m in made)
    kept = ["999.1.1.1", "1.2.3", "000-12-3456", "666-12-3456", "123-00-4567", "01.2.3.4", "12345", "v1.2.3.4.5"]
    assert pseudonyms(spark, kept) == kept


def test_dates_stay_dates(spark):
    rng = random.Random(3)
    days = [date(1900, 1, 1) + timedelta(rng.randrange(pii.DAYS)) for _ in range(25)]
    iso = pseudonyms(spark, [f"{d:%Y-%m-%d}" for d in days])
    german = pseudonyms(spark, [f"{d:%d.%m.%Y}" for d in days])
    american = [d for d in days if d.day > 12]
    month_first = pseudonyms(spark, [f"{d:%m/%d/%Y}" for d in american])
    assert len(set(iso)) == len(set(days))
    for k, d in enumerate(days):
        number = (d - date(1900, 1, 1)).days
        while True:
            a, b = plain_pair(*divmod(number, 270), *pii.DAY_BOUNDS, "date")
            number = a * 270 + b
            if number < pii.DAYS:
                break
        new = date(1900, 1, 1) + timedelta(number)
        assert (iso[k], german[k]) == (f"{new:%Y-%m-%d}", f"{new:%d.%m.%Y}")
    assert all(int(m[3:5]) > 12 and 1 <= int(m[:2]) <= 12 for m in month_first)
    kept = ["1987-02-30", "1850-01-01", "31.04.2001", "13/13/2001", "2001-1-1"]
    assert pseudonyms(spark, kept) == kept


def test_mail_iban_and_text_around(spark):
    texts = [
        "write to Ann.Lee+x@mail.example.com, or ann.lee@example.com.",
        "DE89 3704 0044 0532 0130 00 / DE89370400440532013000",
        None,
        "",
        "no data",
        "é" * 70_000 + " 10.0.0.1",
    ]
    new = pseudonyms(spark, texts)
    local = re.fullmatch(r"write to ([A-Z][a-z]{2}\.[A-Z][a-z]{2}\+[a-z])@mail\.example\.com, or ([a-z]{3}\.[a-z]{3})@example\.com\.", new[0])
    assert local and local[1].replace(".", "").replace("+", "") == plain_string("AnnLeex", "email", "mail.example.com")
    spaced, plain = new[1].split(" / ")
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000"
    assert int(plain[4:] + "1314" + plain[2:4]) % 97 == 1
    assert new[2] is None and new[3:5] == ["", "no data"]
    assert new[5].startswith("é" * 70_000) and not new[5].endswith(" 10.0.0.1")


CARD, PHONE, OTHER_PHONE, IBAN = "4111 1111 1111 1111", "555-123-4567", "555-123-4568", "ES91 2100 0418 4502 0005 1332"


def test_values_beside_other_digits(spark):
    alone = dict(zip([CARD, PHONE, OTHER_PHONE, IBAN], pseudonyms(spark, [CARD, PHONE, OTHER_PHONE, IBAN]), strict=True))
    plain_card, day = CARD.replace(" ", ""), "2024-01-15"
    alone[plain_card], alone[day] = pseudonyms(spark, [plain_card, day])
    assert all(new != old for old, new in alone.items())
    texts = [
        f"{CARD} 05/27", f"item 12 {plain_card}", f"{plain_card} 123", f"{PHONE} {OTHER_PHONE}", f"{PHONE} {day}", f"{IBAN} CALL me",
        f"7 {CARD} 05/27 123", f"{CARD}-{CARD}", f"{CARD}  {plain_card}", f"2021 2022 2023 2024 {CARD}", f"x{CARD}y {IBAN}5",
    ]
    for text, new in zip(texts[:-1], pseudonyms(spark, texts[:-1]), strict=True):
        want = text
        for old in (CARD, plain_card, PHONE, OTHER_PHONE, IBAN, day):
            want = want.replace(old, f"<{old}>")
        for old in alone:
            want = want.replace(f"<{old}>", alone[old])
        assert new == want, text
    # An IBAN with a character too many is none; letters end a card number.
    assert pseudonyms(spark, texts[-1:])[0] == f"x{alone[CARD]}y {IBAN}5"


def test_every_kind_beside_every_other(spark):
    kinds = {"card": CARD, "phone": PHONE, "iban": IBAN, "ip": "10.20.30.40", "date": "2024-01-15", "ssn": "123-45-6789",
             "email": "bob@x.org", "plain": CARD.replace(" ", ""), "amex": "3782 822463 10005", "german": "15.01.2024"}
    alone = dict(zip(kinds, pseudonyms(spark, list(kinds.values())), strict=True))
    pairs = [(a, b, sign) for a in kinds for b in kinds for sign in (" ", ", ", "; ", "\n", " / ")]
    new = pseudonyms(spark, [f"{kinds[a]}{sign}{kinds[b]}" for a, b, sign in pairs])
    wrong = [(pair, made) for pair, made in zip(pairs, new, strict=True) if made != f"{alone[pair[0]]}{pair[2]}{alone[pair[1]]}"]
    assert not wrong


def test_mail_of_one_name_at_two_domains(spark):
    one, other, again = pseudonyms(spark, ["robert@x.org", "robert@y.org", "robert@X.org"])
    assert one.split("@")[0] != other.split("@")[0] and again.split("@")[0] == one.split("@")[0]


def test_phones_that_are_none_stay(spark):
    kept = ["000-000-0000", "000-123-4567", "(555) 555-5555", "5555555555555555"]
    assert pseudonyms(spark, kept) == kept


def test_long_runs_of_digits_take_linear_time(spark):
    import time

    start = time.time()
    texts = ["1 2 3 4 5 6 7 8 9 " * 8_000, "12-" * 40_000, f"{PHONE} " * 3_000, "1" * 120_000]
    new = pseudonyms(spark, texts)
    assert new[2] == pseudonyms(spark, [PHONE])[0].join(["", " "]) * 3_000
    assert new[3] == texts[3] and time.time() - start < 120


def test_pseudonyms_keep_other_columns(spark):
    frame = spark.createDataFrame([(1, "10.0.0.1", "k", None)], "doc_id long, text string, kinds string, left long")
    new = pii.pseudonymized(frame)
    assert new.schema.names == frame.schema.names and new.filter("false").count() == 0
    assert [r["k"] for r in frame.select(pii.replaced_kinds("text").alias("k")).collect()] == [["ip"]]
    other = pii.pseudonymized(frame, key="another").collect()[0]["text"]
    assert other not in ("10.0.0.1", new.collect()[0]["text"])


# --- top k -------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        v = (rng.integers(-3, 3, 5) / 16).tolist() if k % 3 else [0.1] * 5
        v = {7: None, 8: [1.0, None, 2.0], 9: [math.nan] * 5, 11: [1e12, -1e13, 3e18], 12: [1.0, 2.0], 13: []}.get(k % 50, v)
        rows.append((k - 40 if k % 80 == 40 else k, v, "x"))
    rows += [(None, [9.0] * 5, "x"), rows[20]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    got = topk.top_k(topk.quantized(frame), F.col("vec_id") % 20 == 0, shard_rows=37, leaves=4)
    top = 2**63 - 1
    whole = [
        (i, [max(-(2**63), min(top, math.floor(64 * x))) for x in v])
        for i, v, _ in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    wanted = []
    for own, q in {(i, tuple(v)) for i, v in whole if i is not None and i % 20 == 0}:
        scores = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=False)), top if i is None else i) for i, v in whole if i != own
        )
        wanted += [
            (own, rank, None if i == top else i, max(-(2**63), min(top, -s))) for rank, (s, i) in enumerate(scores[:20], 1)
        ]
    key = lambda row: tuple((x is None, x or 0) for x in row)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted, key=key)
    few = topk.top_k(topk.quantized(frame.limit(3)), F.col("vec_id") == 0)
    assert few.count() == 2
    assert topk.top_k(topk.quantized(frame.filter("false")), F.col("vec_id") == 0).collect() == []


def test_search_leaves_shards_out_before_the_shuffle():
    """Of clustered vectors, a query asks the shards of few leaves; and of any, never too few."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (16, 6))
    points = np.concatenate([c + rng.integers(-9, 9, (100, 6)) for c in centres])
    space = topk.Space(points.astype(float), 16)
    leaf = space.leaf_of(points.astype(float))
    assert 8 <= len(set(leaf.tolist())) <= 16
    rows = []
    for number in set(leaf.tolist()):
        own = points[leaf == number]
        rows += [(number, -1, 0, 0, len(own))] + [(number, k, int(own[:, k].min()), int(own[:, k].max()), len(own)) for k in range(6)]
    boxes = topk.Boxes(rows, 50)
    kept = 0
    for query in points[::40]:
        scores = points @ query
        kth = np.sort(scores)[-20]
        near = set(boxes.leaf[boxes.most(query) >= kth].tolist())
        assert set(leaf[scores >= kth].tolist()) <= near
        kept += len(near)
    assert kept < 0.5 * len(points[::40]) * len(boxes.leaf)


def test_leaves_of_odd_samples():
    for points in (np.zeros((0, 0)), np.zeros((5, 0)), np.ones((50, 3))):
        assert topk.Space(points, 8).leaves == 1
        assert topk.Space(points, 8).leaf_of(np.ones((4, 2))).tolist() == [0] * 4


def test_search_leaves_nodes_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (8, 4))
    points = np.concatenate([c + rng.integers(-9, 9, (200, 4)) for c in centres]).astype(float)
    tree = topk.Tree(np.arange(1600), points, leaf=32)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                seen.append(at)
            return np.asarray(self)[at]

    tree.points = tree.points.view(Counted)
    query = centres[2].astype(float)
    found = tree.search(query, -1, 10, None)
    scores = points @ query
    assert [s for s, _ in found] == sorted(scores.tolist(), reverse=True)[:10]
    leaves = sum(not c for c in tree.children)
    assert len(seen) < leaves / 2


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_on_planted_cases(spark, tmp_path):
    rng = random.Random(31)
    rows, labels = [], []
    for k in range(300):
        words = [f"{rng.choice(CLEAN)}{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}" for _ in range(rng.randint(30, 80))]
        if k % 6 == 0:
            words.insert(3, TOXIC[k % 3])
            words.insert(9, TOXIC[(k + 1) % 3])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 6 == 0)))
    item = " ".join(f"{rng.choice(CLEAN)}q{j}" for j in range(30))
    rows += [(400, rows[1][1]), (401, rows[2][1]), (402, f"before it {item} after it"), (403, "card 4111111111111111 is hers")]
    rows += [(404, None), (405, "")]
    full = [(k, text, "en", "s", len(text or "")) for k, text in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{number}")
        kept = spark.read.parquet(f"{tmp_path}/{number}")
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == {k for k in range(300) if k % 6} | {403, 404}
    assert "4111111111111111" not in texts[403]
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in placed} == set(texts)
    assert sum(r["length"] for r in placed) == sum(r["length"] for r in corpus_pipeline.packed(spark, kept, "").collect())


def test_pipeline_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
