"""The corpus operators against brute force, on edge rows and on a small table."""

import base64
import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, cdc, entries, jaccard, media, packing, pii, quality_rules, repeats, sharding, suffix_sort, warc

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(3000, 1)
PASSAGE = prose(120, 2)
NEAR = prose(200, 3)
EDGE = [
    (1, None, "en", "s"),
    (2, "", "en", "s"),
    (3, "  \n\t ", None, None),
    (4, LONG, "en", "s"),
    (5, LONG, "en", "s"),
    (5, LONG, "en", "s"),
    (6, NEAR, "en", "s"),
    (7, NEAR + " one more", "en", "s"),
    (8, prose(80, 5) + " " + PASSAGE + " " + prose(60, 6), "de", "s"),
    (9, prose(70, 7) + " " + PASSAGE, "fr", "t"),
    (10, "Four words in here", "en", "s"),
    (11, "FOUR words in here", "en", "s"),
    (12, "a" * 3000, "en", "s"),
    (13, "mail Ann.Lee@mail.example.org or +44 (20) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.255 not 300.1.1.1", "en", "s"),
    (14, "é日本😀 ünïcode " * 40, "es", "s"),
    (None, "without an id", None, None),
    (None, None, None, None),
    (17, "an <|endoftext|> and<|startoftext|>, or <|ENDOFTEXT|>", "en", "s"),
    (15, "#$% " * 50 + "\nsame line\nsame line\n", "en", "s"),
    (16, "one two three four five one two three four five " * 20, "en", "s"),
]


def table(spark, rows):
    """Documents with columns beside theirs whose names clash."""
    full = [(i, t, l, s, None if t is None else len(t), "x", 1, 2) for i, t, l, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, shard int, row int")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    spark.conf.set("spark.sql.caseSensitive", "true")
    path = str(tmp_path_factory.mktemp("docs") / "t")
    table(spark, EDGE).repartition(3).write.parquet(path)
    yield spark.read.parquet(path)
    spark.conf.set("spark.sql.caseSensitive", "false")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    table(spark, EDGE).where("false").write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_library(docs, ranks):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = []
    for i, t, _, _ in EDGE:
        ids = own.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(found) == sorted(expected, key=repr)


def test_bpe_columns(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.decode_column(bpe.encode_column(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["data"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, _, _ in EDGE)


def test_prefixes_append_and_edit(ranks):
    v = bpe.Vocabulary(ranks)
    r = random.Random(8)
    for _ in range(60):
        data = bytes(r.choice(b"aeinrst th") for _ in range(r.randint(1, 60)))
        grown = bpe.Prefixes(v)
        for b in data:
            grown.append(bytes([b]))
        assert grown.last == bpe.Prefixes(v, data).last and grown.tokens() == v.merge(data)
        a = r.randint(0, len(data))
        b = r.randint(a, len(data))
        grown.replace(a, b, b"ing")
        assert grown.last == bpe.Prefixes(v, data[:a] + b"ing" + data[b:]).last


# 2


def covered(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        yield d, mask


@pytest.mark.parametrize("length,anchor", [(400, 200), (60, 20)])
def test_repeats_equal_brute_force(docs, length, anchor):
    expected = []
    for (i, _, _, _), (d, mask) in zip(EDGE, covered([r[1] for r in EDGE], length), strict=True):
        kept = bytes(np.frombuffer(d, np.uint8)[~mask])
        expected.append((i, len(d), int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert rows_of(repeats.remove(docs, length=length, anchor=anchor)) == sorted(expected, key=repr)


@pytest.mark.parametrize("hot", [1, 3000])
def test_hot_names_are_split(spark, tmp_path, monkeypatch, hot):
    """One long line in many different contexts, some of them alike: split by the bytes around it, down to single windows."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", hot)
    monkeypatch.setattr(repeats, "REMEMBERED", 3)
    r = random.Random(9)
    line, near = prose(12, 77), prose(6, 78)
    ends = ["", "x", near, near[:20], near[:20] + "y", line[:30]]
    texts = [prose(r.randint(0, 9), 500 + i % 37) + r.choice(ends) + line + r.choice(ends) + prose(r.randint(0, 9), 900 + i % 41) for i in range(120)] + [line + line + line, line[:60], "", None]
    table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3).write.parquet(path := f"{tmp_path}/t")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove(spark.read.parquet(path), length=60, anchor=20).collect()}
    for i, (d, mask) in enumerate(covered(texts, 60)):
        kept = bytes(np.frombuffer(d, np.uint8)[~mask])
        assert got[i] == (int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()), i
    assert sum(n for n, _, _ in got.values()) > 5000


def test_shards_larger_than_the_queue(tmp_path):
    """A string mapped from a file whose order spills and whose names are sorted by induction again."""
    data = (prose(9000, 31) + prose(4000, 32) + prose(9000, 31)[:20_000]).encode()
    (tmp_path / "shard").write_bytes(data)
    text = np.memmap(tmp_path / "shard", np.uint8, "r")
    sorter = suffix_sort.SuffixSorter(50, str(tmp_path), memory=30_000, base=1000)
    order, common = sorter.ascending(text)
    assert sorter.spilled > 10 and [p.name for p in tmp_path.iterdir()] == ["shard"]
    assert sorted(order.tolist()) == list(range(len(data)))
    for i, j, n in zip(order.tolist(), order[1:].tolist(), common[1:].tolist(), strict=False):
        x, y = data[i : i + 50], data[j : j + 50]
        assert x <= y and n == len(os.path.commonprefix([x, y]))


def test_suffix_sorting_in_memory_and_external():
    r = random.Random(3)
    for k in range(120):
        text = bytes(r.randint(0, r.choice([1, 3, 255])) for _ in range(r.randint(1, 70)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0]
        for i, j in zip(order, order[1:], strict=False):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            common.append(n)
        sorter = suffix_sort.SuffixSorter(400, memory=64 if k % 2 else 1 << 20, base=1 if k % 3 else 1 << 20)
        a, b = sorter.ascending(np.frombuffer(text, np.uint8))
        assert (a.tolist(), b.tolist()) == (order, common)


# 3


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/%0A", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\nv", ""), (4, "u", None), (None, "n", "<p>x</p>"), (5, "b", "y" * 700_000), (2, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages, folder)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(index, folder).collect()), key=repr)
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        largest = max(j for j, _, g in rows if (g or "") == (h or "") and j is not None)
        expected.append((i, "response" if i == largest else "revisit", None if i == largest else largest, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()))
    assert got == sorted(expected, key=repr)
    one = warc.read(index.where("page_id = 5"), folder).collect()
    assert bytes(one[0]["payload"]) == b"y" * 700_000
    assert {r["url"] for r in warc.read(index, folder).collect()} == {u for _, u, _ in rows}
    assert warc.archive(pages.where("false")).count() == 0
    assert {r["record_type"] for r in warc.archive(pages, min_bytes=1 << 20).collect()} == {"response"}


# 4

KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    return sum((d * 2 - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    found = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_pii_base_equals_patterns(spark, docs):
    r = random.Random(6)
    parts = ["a@b.c", "x_y@e.f.", "@", ".", "1.2.3.4", "255.0.0.1", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+", " ", "-", "7", "é", "\n", "12345678901234567890", "%", "_"]
    made = [(100 + i, "".join(r.choice(parts) for _ in range(r.randint(1, 25))), "en", "s") for i in range(300)]
    for rows, frame in ((made, table(spark, made)), (EDGE, docs)):
        got = pii.report(frame).collect()
        expected = Counter()
        for i, t, _, _ in rows:
            spans = base_spans(t)
            expected[(i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())] += 1
        assert Counter(tuple(x)[:6] for x in got) == expected
        for x in got:
            assert all(s.split(":")[0] == "term" for s in x["spans"].split(",") if s and s.split(":")[0] not in dict(KINDS))


def test_pii_terms_give_an_entity_away(spark):
    rows = [(i, f"{prose(30, i)} zanzibar ann@x.org {prose(30, 50 + i)}", "en", "s") for i in range(3)] + [(10 + i, prose(60, 100 + i), "en", "s") for i in range(30)]
    found = {r["doc_id"]: r["spans"] for r in pii.report(table(spark, rows)).collect()}
    for i, t, _, _ in rows[:3]:
        at = t.index("zanzibar")
        assert f"term:{at}:{at + 8}" in found[i]
    assert all(not found[10 + i] for i in range(30))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table(spark, rows), ("doc_id", "text")).collect()}
    assert all("[TERM] [EMAIL]" in clean[i] and "@" not in clean[i] for i in range(3))
    assert all(clean[i] == t for i, t, _, _ in rows[3:])


def test_pii_reach_crosses_other_matches(spark):
    """Terms by brute force: other numbers, invalid matches and a second e-mail don't cut the reach."""
    r = random.Random(8)
    cards = ["4111 1111 1111 1111", "5500000000000004", "340000000000009"]
    parts = [*cards, "room 12,", "no. 7;", "300.1.1.1", "10.0.0.7", "ann@x.org", "bob.lee@mail.example.org", "+1 (234) 567-8901", "é😀", "d'or-", "\n", "--x", *WORDS[:40]]
    some = lambda n: " ".join(r.choice(parts) for _ in range(r.randint(0, n)))
    texts = [f"{prose(40, i)} Annabel Quixote, room {i}, card 6011000000000004 {prose(40, 90 + i)}" for i in range(3)]
    names = ["".join(r.choice("klmnop'é") for _ in range(6)) + "q" for _ in range(40)]
    own = lambda i: (f"u{i}@own.org", f"10.1.{i}.7", f"+49 30 {7000000 + i}")[i % 3]
    texts += [f"{some(20)} {name} {some(8)} {own(i)} {some(8)} {name[::-1]} {some(20)}" for i, name in enumerate(names) for _ in range(3)] + [prose(60, 200 + i) for i in range(150)]
    near, n_e, n_t, n_et = [], Counter(), Counter(), Counter()
    for text in texts:
        spans, blank, at = base_spans(text), list(text), {}
        for a, _, b in spans:
            blank[a:b] = [c if c in "'-" and "@" not in text[a:b] else " " for c in text[a:b]]
        runs = [(m.start(), m.end()) for m in re.finditer(r"(?:[^\W\d_]|['-])+", "".join(blank))]
        for a, b in runs:
            if w := re.search(r"[^\W\d_](?:[^\W\d_]|['-]){2,}", text[a:b]):
                at[a + w.start(), a + w.end()] = (a, b)
        found = {(text[a:b], text[c:d].lower(), c, d) for a, _, b in spans for (c, d), (x, y) in at.items() if a - 80 <= x and y <= a or b <= x and y <= b + 80}
        near.append(found)
        n_e.update({text[a:b] for a, _, b in spans})
        n_t.update({w.lower() for w in re.findall(r"[^\W\d_](?:[^\W\d_]|['-]){2,}", text)})
        n_et.update({x[:2] for x in found})
    n = len(texts)
    telling = {(e, t) for (e, t), k in n_et.items() if k >= 2 and n_e[e] < n and math.log2(k * n / (n_e[e] * n_t[t])) >= 0.9 * math.log2(n / n_e[e])}
    expected = [sorted({x[2:] for x in found if x[:2] in telling}) for found in near]
    got = {x["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("term:")] for x in pii.report(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(n)] == expected and sum(map(len, expected)) > 100
    assert all((t.index("Quixote"), t.index("Quixote") + 7) in got[i] for i, t in enumerate(texts[:3]))


# 5


def test_quality_statistics(docs):
    got = quality_rules.score(docs, []).collect()
    expected = Counter()
    for i, t, _, _ in EDGE:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {k + d for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for d in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        expected[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed, not failed)] += 1
    assert Counter(tuple(r) for r in got) == expected


def test_decision_list_held_out(spark):
    sf = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.learn(quality_rules.labelled_sample(frame, labels.where("doc_id % 2 = 0")))
    assert rules
    held = quality_rules.score(frame, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality", "base_failed").collect()
    good = [r for r in held if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in held if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_no_labels_no_rules(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(quality_rules.labelled_sample(docs, labels)) == []


# 6


def test_sharding_counts_and_slots(spark, docs, empty):
    shuffled = sharding.two_pass_shuffle(docs, ("doc_id", "text"), bucket_bytes=4000)
    placed = sharding.deal(shuffled.drop("text"), shuffled, 4).collect()
    shards = {}
    for r in placed:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(s) for s in shards.values()) == sorted([5, 5, 5, 5])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert Counter(r["doc_id"] for r in placed) == Counter(i for i, *_ in EDGE)
    none = sharding.two_pass_shuffle(empty, ("doc_id", "text"))
    assert sharding.deal(none, none, 4).count() == 0


def test_offsets_over_runs(spark):
    counts = [(b, (b * 7) % 5 + 1) for b in range(50) if b % 9]
    got = {r[0]: r[1] for r in sharding._offsets(spark.createDataFrame(counts, "__bucket int, __n long"), run=8).collect()}
    assert got == {b: sum(n for c, n in counts if c < b) for b, _ in counts}


def test_shuffle_query(spark):
    """op6 itself by brute force: sizes, checksums, the law, gapless slots, and an order that isn't the input's."""
    sf = "/root/testdata/sf0.001"
    texts = Counter((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = entries.op6_two_pass_shuffle(spark, sf).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.elements())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], {})[r["slot"]] = r["doc_id"]
    assert set(shards) == set(range(40)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sum(map(len, shards.values())) == len(got) and all(set(s) == set(range(len(s))) for s in shards.values())
    order = [shards[k % 40][k // 40] for k in range(len(got))]
    ups = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 0.35 * len(got) < ups < 0.65 * len(got)
    assert [tuple(r) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == [tuple(r) for r in sorted(entries.op6_two_pass_shuffle(spark, sf).collect(), key=lambda r: (r["shard"], r["slot"]))]


def test_shard_files(docs, tmp_path, spark):
    shuffled = sharding.two_pass_shuffle(docs, ("doc_id", "text"))
    sharding.write_shards(sharding.deal(shuffled, shuffled, 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(EDGE)


# 7


def shingle_set(text):
    words = (text or "").encode().translate(jaccard.LOWER).split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_jaccard_edges(docs, empty):
    assert rows_of(jaccard.groups(docs)) == brute_components([(i, t) for i, t, _, _ in EDGE])
    assert jaccard.groups(empty).count() == 0
    kept = jaccard.first_of_groups(docs, ("doc_id", "text")).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted([1, 2, 3, 4, 6, 8, 9, 10, 12, 13, 14, None, None, 15, 16, 17], key=repr)


def test_jaccard_borderline_clusters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "UNIT", 6)
    r = random.Random(11)
    rows = []
    for c in range(3):
        base = prose(60, 200 + c).split()
        for _ in range(25):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"w{r.random()}"
            rows.append((len(rows), " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    assert rows_of(jaccard.groups(spark.read.parquet(str(tmp_path / "t")))) == brute_components(rows)


def test_prefix_bounds():
    for n in range(1, 1500):
        prefix, least = jaccard._required(n)
        assert n - jaccard.needed(n) + least <= prefix or prefix == n
        for m in range(jaccard.needed(n), n + 1):
            assert max(1, m // 12) >= least


# 8


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, ids=True).collect()
    sequences, texts = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        texts.setdefault(p["doc_id"], []).append((p["start"], p["ids"]))
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["length"] == len(p["ids"]) > 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    for i, text, _, _ in EDGE:
        if sum(d == i for d, *_ in EDGE) == 1:
            ids = [x for _, part in sorted(texts[i]) for x in part]
            assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 2]
    whole = Counter(tuple([*t.encode(text or "", add_special_tokens=False).ids, 2]) for i, text, _, _ in EDGE)
    assert Counter(len(w) for w in whole.elements()) == Counter({n: k // n for n, k in Counter(x["doc_tokens"] for x in pieces for _ in range(x["length"])).items()})
    assert packing.pack(empty, path).count() == 0


def test_word_tokens_equal_library():
    """Added tokens, marks, cases and characters beyond ASCII, in any neighbourhood."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, r = Tokenizer.from_file(path), random.Random(12)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "<|", "word", "Word", "don't", "'S", "...", ",", " ", "\n", "\t", "7", "é", "e\u0301", "日本", "😀", "ß", "İ", "\u00a0", "_", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    words = packing.WordTokens(path)
    got = [np.frombuffer(x, "<u2").tolist() for at in range(0, len(texts), 500) for x in words.encode([t.encode() for t in texts[at : at + 500]])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_balances_cost():
    r = random.Random(1)
    lengths = [r.randint(1, 1500) for _ in range(3000)]
    pieces = packing.plan(lengths)
    spent = {}
    for p in pieces:
        spent[p.sequence] = spent.get(p.sequence, 0) + packing.cost(p.length)
    whole = sorted(spent.values())[20:]
    assert max(whole) < 1.6 * min(whole)
    assert sum(p.length for p in pieces) == sum(lengths)


def test_plan_cuts_only_without_room():
    """Every piece by brute force: the cheapest of all open sequences with room; cut only where none has it."""
    r = random.Random(3)
    for lengths in ([r.randint(1, 4095) for _ in range(600)], [r.choice((3000, 1000, 97, 1)) for _ in range(900)], [2100] * 120 + [1900] * 100 + [1990] * 30):
        total, cap = sum(lengths), packing.CAPACITY
        rooms = [cap] * (total // cap) + [1 << b for b in range(12, -1, -1) if total % cap >> b & 1]
        spent = [packing.cost(cap) * (1 - room / cap) for room in rooms]
        filled, expected = [0] * len(rooms), []
        for n, doc in sorted(((n, d) for d, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
            start = 0
            while n:
                free = [i for i in range(len(rooms)) if rooms[i] > filled[i]]
                i = min([i for i in free if rooms[i] - filled[i] >= n] or free, key=lambda i: (spent[i], i))
                part = min(n, rooms[i] - filled[i])
                expected.append(packing.Piece(doc, start, part, i, filled[i]))
                filled[i], spent[i], start, n = filled[i] + part, spent[i] + packing.cost(part), start + part, n - part
        assert packing.plan(lengths) == expected


# 9


def test_media(spark, docs, empty):
    got = media.media_columns(docs, range_bytes=700).collect()
    expected = Counter()
    for i, t, _, _ in EDGE:
        payload = media.pad((t or "").encode())
        stored = media.encode(payload)
        assert media.decode(stored) == payload and len(payload) % 64 == 0 and payload
        expected[(i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))] += 1
    assert Counter(tuple(r) for r in got) == expected
    assert media.media_columns(empty).count() == 0


def test_media_retries_a_member(spark, docs, tmp_path):
    from pyarrow import fs

    folder = f"file://{tmp_path}/m"
    media.write_archives(docs.coalesce(1), folder)
    reader = media.MediaReader({"path": folder, "rangebytes": "100000"})
    part = reader.partitions()[0]
    store, path = fs.FileSystem.from_uri(part.path)
    offsets = json.loads((tmp_path / "m" / f"{path.rsplit('/', 1)[1]}.idx").read_text())

    class Broken:
        def seek(self, at):
            raise OSError("lost")

    _, name, data = reader._member(store, path, Broken(), offsets[1])
    assert media.decode(data) and name.endswith(".png")
    with pytest.raises(OSError):
        media.MediaReader({"path": folder})._member(store, path + ".gone", None, 0)


# 10


def test_chunks_resist_insertions():
    table_ = cdc.gear_table()
    data = LONG.encode()
    whole = {data[a:b] for a, b in zip([0, *cdc.cuts(data, table_)], cdc.cuts(data, table_), strict=False)}
    moved = data[:500] + b"inserted" + data[500:]
    again = {moved[a:b] for a, b in zip([0, *cdc.cuts(moved, table_)], cdc.cuts(moved, table_), strict=False)}
    assert len(whole - again) <= 3


def test_chunk_dedup(docs, empty):
    got = {}
    for r in cdc.deduplicate(docs, texts=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sorted(r["n_removed"] for i in (4, 5) for r in got[i]) == [0, len(LONG), len(LONG)]
    assert sum(r["n_removed"] >= 400 for i in (8, 9) for r in got[i]) == 1
    assert all(r["n_repeated"] >= 400 for i in (8, 9) for r in got[i])
    assert got[10][0]["n_removed"] == got[13][0]["n_removed"] == 0
    assert bytes(got[10][0]["kept"]) == b"Four words in here"
    assert cdc.deduplicate(empty).count() == 0


def chunks_of(data, table_):
    """Gear-hash chunks byte by byte: (start, end)."""
    h, start, found = 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(table_[b])) & 0xFFFF
        if h >> 12 == 0:
            found.append((start, i + 1))
            start = i + 1
    return found + ([(start, len(data))] if start < len(data) else [])


def test_chunk_dedup_equals_brute_force(spark, docs, tmp_path):
    """Every column, chunk by chunk in plain Python: edge rows, shared passages of 40 to 60 words, lines below the least run."""
    r = random.Random(21)
    shared = [prose(r.randint(40, 60), 4000 + i) for i in range(12)] + [prose(25, 4100), "one line of it"]
    more = [(1000 + i, f"{prose(r.randint(0, 60), 5000 + i)} {r.choice(shared)} {prose(r.randint(0, 60), 6000 + i)}", "en", "s") for i in range(80)]
    table(spark, more + more[:3] + [(2000, shared[0], "en", "s"), (2001, shared[-1], "en", "s"), (2002, shared[-1], "en", "s")]).repartition(4).write.parquet(path := f"{tmp_path}/t")
    table_ = cdc.gear_table()
    for frame in (docs, spark.read.parquet(path)):
        rows = [((x["doc_id"], x["text"] or "")) for x in frame.withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()]
        cut = [chunks_of(t.encode(), table_) for _, t in rows]
        pieces = [[t.encode()[a:b] for a, b in c] for (_, t), c in zip(rows, cut, strict=True)]
        count, seen, expected = Counter(p for ps in pieces for p in ps), set(), Counter()
        for (i, t), c, ps in zip(rows, cut, pieces, strict=True):
            data, again = t.encode(), []
            for p in ps:
                again.append(p in seen)
                seen.add(p)

            def runs(flags):
                found, at = [], 0
                while at < len(flags):
                    end = at
                    while end < len(flags) and flags[end]:
                        end += 1
                    if end > at:
                        a, b = c[at][0], c[end - 1][1]
                        low, high = max(0, c[max(0, at - 1)][0] - 15), c[min(end, len(c) - 1)][1]
                        if b - a >= 400 or b - a == len(data) or len(data[low:high].split()) > 50:
                            found.append((a, b))
                    at = end + 1
                return found

            gone = runs(again)
            kept = bytes(x for k, x in enumerate(data) if not any(a <= k < b for a, b in gone))
            expected[(i, len(data), len(c), sum(b - a for a, b in runs([count[p] > 1 for p in ps])), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())] += 1
        assert Counter(tuple(x) for x in cdc.deduplicate(frame).collect()) == expected
        assert sum(n for x, n in expected.items() if x[4]) > 2


def test_chunk_dedup_of_short_texts_and_words(spark, tmp_path):
    """Copies below the least run, and passages of 51 short words inside other texts."""
    r = random.Random(11)
    copies = [(i, "a short line, said again", "en", "s") for i in range(4)]
    passages = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice(["", "x", "y"]) for _ in range(51)) for _ in range(40)]
    held = [(100 + 2 * i + j, f"{prose(30, 1000 + 2 * i + j)} {p} {prose(30, 2000 + 2 * i + j)}", "en", "s") for i, p in enumerate(passages) for j in range(2)]
    table(spark, copies + held).coalesce(1).write.parquet(path := f"{tmp_path}/t")
    got = {x["doc_id"]: x for x in cdc.deduplicate(spark.read.parquet(path), texts=True).collect()}
    assert [bytes(got[i]["kept"]) for i in range(4)] == [b"a short line, said again", b"", b"", b""]
    assert all(got[i]["n_repeated"] == got[i]["n_bytes"] == 24 for i in range(4))
    table_, missed = cdc.gear_table(), []
    for i, p in enumerate(passages):
        assert 101 <= len(p) < 160
        pieces = [{d[a:b] for a, b in zip([0, *c], c, strict=False)} for d in (held[2 * i + j][1].encode() for j in range(2)) for c in [cdc.cuts(d, table_).tolist()]]
        common = [x for x in pieces[0] & pieces[1] if x in p.encode() and len(x) > 8]
        if common and not (got[100 + 2 * i]["n_repeated"] and got[101 + 2 * i]["n_removed"]):
            missed.append(p)
    assert not missed


# The pipeline


def without_passages(texts):
    """Brute force of the stage: sequences of 51 words that stand twice in runs covered by repeated strings of 101 bytes; runs of 400 bytes without spaces."""
    runs = []
    for d, mask in covered(texts, 101):
        own = []
        for a, b in np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0])))).reshape(-1, 2).tolist():
            n = len(d[a:b].split())
            unspaced = b - a >= 400 and 16 * n < b - a
            if n > 50 or unspaced:
                while a < b and d[a] & 0xC0 == 0x80:
                    a += 1
                text = d[a:b].decode(errors="ignore").encode()
                own.append((a, text, unspaced, [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]))
        runs.append((d, own))
    words = lambda text, edges: [text[x:y] for x, y in edges]
    seen = Counter(tuple(w[k : k + 51]) for _, own in runs for _, text, _, edges in own for w in [words(text, edges)] for k in range(len(w) - 50))
    for t, (d, own) in zip(texts, runs, strict=True):
        gone = np.zeros(len(d), bool)
        for a, text, unspaced, edges in own:
            if unspaced:
                gone[a : a + len(text)] = True
            w = words(text, edges)
            for k in range(len(w) - 50):
                if seen[tuple(w[k : k + 51])] > 1:
                    gone[a + edges[k][0] : a + edges[k + 50][1]] = True
        yield None if t is None else bytes(np.frombuffer(d, np.uint8)[~gone]).decode(errors="ignore")


def test_passages_by_words(spark, tmp_path):
    """Passages of 51 one-letter words go; two repeated runs of 30 words that only together have more, and 50 words, stay."""
    import corpus_pipeline as cp

    r = random.Random(31)
    letters = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51)) for _ in range(5)]
    a, b, fifty = prose(30, 41), prose(30, 42), prose(50, 43)
    texts = [f"{prose(20, 100 + i)} {x} {prose(20, 200 + i)}" for i, x in enumerate([*letters, *letters, f"{a} {b}", a, b, fifty, fifty, PASSAGE, PASSAGE.replace(" ", "\n", 1)])]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    table(spark, rows).repartition(3).write.parquet(path := f"{tmp_path}/t")
    got = {x["doc_id"]: x["text"] for x in cp.repeated_substrings(spark, spark.read.parquet(path), "").collect()}
    assert got == dict(enumerate(without_passages(texts)))
    assert all(len(got[i].split()) == 40 for i in range(10)) and all(got[i] == texts[i] for i in range(10, 15))
    assert len(got[15].split()) < 45


def test_long_periodic_texts(spark, tmp_path):
    """Megabytes of one symbol, of a period of 7 and of a line, among texts that share windows with them."""
    from xxhash import xxh3_64_intdigest as digest

    line = "=" * 79 + "\n"
    texts = ["=" * 3_000_000, "ab cdef" * 200_000 + prose(30, 5), prose(40, 6) + line * 9000 + prose(40, 7), "x" + "=" * 500 + "y", prose(9, 8) + line * 8 + "=" * 390, "cdefab " * 60, "=" * 399, "-" * 401, "-" * 400 + "+", "=" * 1250 + "!" + "=" * 1300]
    texts.append(texts[2][100_000:103_000] + "tail")
    data = [t.encode() for t in texts]
    seen = Counter(digest(d[i : i + 400]) for d in data for i in range(len(d) - 399))
    table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(2).write.parquet(path := f"{tmp_path}/t")
    got = {x["doc_id"]: x for x in repeats.remove(spark.read.parquet(path)).collect()}
    for i, d in enumerate(data):
        hit = np.array([seen[digest(d[k : k + 400])] > 1 for k in range(len(d) - 399)], np.int32)
        mask = np.cumsum(np.concatenate((hit, np.zeros(min(len(d), 399), np.int32))) - np.concatenate((np.zeros(400, np.int32), hit))[: len(d)])[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~mask])
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(mask.sum()), hashlib.sha256(kept).hexdigest()), i


def test_pipeline_edges(spark, docs, empty, tmp_path):
    """Nulls, empty and repeated rows, clashing columns and an empty table through every stage."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    by_id = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
    kept = by_id(cp.quality(spark, docs, sf))
    assert kept and all(t is not None and len(t.split()) >= 10 for _, t in kept)
    assert [i for i, _ in kept].count(5) in (0, 2)
    first = by_id(cp.near_duplicates(spark, docs, sf))
    assert [i for i, _ in first] == [i for i, *_ in rows_of(jaccard.first_of_groups(docs, ("doc_id", "text")))]
    texts = [t for _, t, _, _ in EDGE]
    assert by_id(cp.repeated_substrings(spark, docs, sf)) == sorted(zip([i for i, *_ in EDGE], without_passages(texts), strict=True), key=repr)
    clean = by_id(cp.personal_data(spark, docs, sf))
    assert len(clean) == len(EDGE) and Counter(t is None for _, t in clean) == Counter(t is None for t in texts)
    assert cp.personal_data(spark, docs, sf).columns == cp.repeated_substrings(spark, docs, sf).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pieces = cp.pack(spark, docs, sf).collect()
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(i for i, *_ in EDGE)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, sf).write.parquet(str(tmp_path / name))
        frame = read(name)
    kept = {r["doc_id"]: r["text"] for r in read("quality").collect()}
    groups = brute_components(sorted(kept.items()))
    assert {r["doc_id"] for r in read("near_duplicates").collect()} == {d for d, n, c in groups if not n or d == c}
    before = read("near_duplicates").collect()
    expected = {r["doc_id"]: t for r, t in zip(before, without_passages([r["text"] for r in before]), strict=True)}
    after = {r["doc_id"]: r for r in read("repeated_substrings").collect()}
    assert {i: r["text"] for i, r in after.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    clean = {r["doc_id"]: r["text"] for r in read("personal_data").collect()}
    assert all(not base_spans(t) for t in clean.values()) and set(clean) == set(expected)
    assert all(clean[i] == t for i, t in expected.items() if not base_spans(t))
    assert {r["doc_id"] for r in read("pack").select("doc_id").collect()} == set(clean)


def test_names():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in entries.queries())] == []
    assert "pipeline" in entries.queries()
