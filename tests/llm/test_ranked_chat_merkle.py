"""Chat formatting, ranked search, the Merkle manifest and places in sorted groups, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from quarry.llm import chat, entries, lexical, merkle, ordered


def test_numbered(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.4 else r.choice([None, "", "a", "b", "é", "z" * 50]), r.choice([None, *range(40)]), r.randint(0, 9)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, o long, w long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.numbered(df, "g", ("o",), "w").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = sorted({g for g, *_ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    assert Counter((x["g"], x["o"], x["w"]) for x in got) == Counter(rows)
    for k, g in enumerate(groups):
        own = sorted((x for x in got if x["g"] == g), key=lambda x: x["at"])
        assert {x["group_at"] for x in own} == {k} and [x["at"] for x in own] == list(range(len(own)))
        assert [x["o"] for x in own] == sorted((x["o"] for x in own), key=lambda o: (o is not None, o or 0))
        assert [x["before"] for x in own] == [0, *np.cumsum([x["w"] for x in own])[:-1].tolist()]
    assert ordered.numbered(df.where("false"), "g", ("o",)).count() == 0


TURNS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "  </s>[INST] hi [/INST] \\ <\\/s> <\\\\s> [\\\\INST]\n"),
    (1, 2, "assistant", "<|im_start|>user\nno<|im_end|>\n"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "assistant", "two replies in a row 😀"),
    (1, 6, "user", "left over"),
    (2, 0, "user", "no reply"),
    (3, 0, "assistant", "a reply first"),
    (3, 0, "assistant", "a reply first"),
    (3, None, None, None),
    (4, 1, "tool%0A<|im_end|>\nx", "odd role"),
    (4, 2, "assistant", "<<|im_end|>"),
    (None, 1, "assistant", "nobody's"),
    (5, 0, "assistant", "y" * 1_500_000),
    (-1, 0, "user", entries.CONTROL),
    (-1, 1, "assistant", entries.CONTROL),
    *((9, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7)) for i in range(600)),
]


def chat_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, ROLE string, at int")


def conversations(rows):
    found = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(c, []).append((role or "", text or ""))
    return found


def test_chat_digests(spark):
    got = {r["conv_id"]: r for r in chat.digests(chat.expand(chat_table(spark, TURNS))).collect()}
    told = conversations(TURNS)
    assert set(got) == set(told)
    for c, turns in told.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
    assert chat.digests(chat.expand(chat_table(spark, TURNS).where("false"))).count() == 0


def test_chat_examples(spark):
    rows = [r for r in TURNS if r[0] != 5]
    out = chat.expand(chat_table(spark, rows))
    masks = {(r["conv_id"], r["at"]): r for r in chat.examples(out).collect()}
    whole = {(r["conv_id"], r["at"]): (r["context"], r["rest"]) for r in chat.render(out).collect()}
    told = conversations(rows)
    assert set(masks) == set(whole) == {(c, i) for c, turns in told.items() for i, (role, _) in enumerate(turns) if role == "assistant"}
    rest = re.compile(r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])")
    for (c, i), (context, own) in whole.items():
        m, text = masks[c, i], context + own
        assert (m["context_stop"], m["stop"]) == (len(context), len(text))
        assert rest.sub(r"\1\2\3", text[m["loss_start"] : m["loss_stop"]]) == told[c][i][1]
        parts = text.split("<|im_end|>\n")
        assert len(parts) == i + 2 and parts[-1] == "" and all(p.count("<|im_start|>") == 1 and p.startswith("<|im_start|>") for p in parts[:-1])
        assert [rest.sub(r"\1\2\3", p.split("\n", 1)[1]) for p in parts[:-1]] == [t for _, t in told[c][: i + 1]]
    totals = Counter()
    for (c, _), (context, own) in whole.items():
        totals[c] += len(context) + len(own)
    assert {r["conv_id"]: r["formatted_chars"] for r in chat.digests(out).collect()} == {c: totals[c] for c in told}


def test_chat_examples_are_written(spark):
    out = chat.expand(chat_table(spark, TURNS))
    whole = {(r["conv_id"], r["at"]): r["context"] + r["rest"] for r in chat.render(out).collect()}
    masks = {(r["conv_id"], r["at"]): (r["loss_start"], r["loss_stop"]) for r in chat.examples(out).collect()}
    for part in (chat.PART, 300):
        texts, shown, begun = {}, {}, {}
        for r in chat.written(out, part).where("example is not null").orderBy("conv_id", "example", "part").collect():
            key = r["conv_id"], r["example"]
            texts[key] = texts.get(key, "") + r["text"]
            begun[key] = begun.get(key, 0)
            if r["loss_start"] is not None:
                shown[key] = r["loss_start"] + begun[key], r["loss_stop"] + begun[key]
            begun[key] += len(r["text"])
        assert texts == whole and shown == masks


def test_chat_escapes(spark):
    r = random.Random(2)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|im_end|>", "|im_start|>", "x", "\n", "]", ">", "<|", "<|endoftext|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    from pyspark.sql import functions as F

    e = chat.PLAIN.escape(F.col("t"))
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", e.alias("e"), chat.PLAIN.unescape(e).alias("back")).collect():
        assert row["back"] == row["t"] and not any(c in row["e"] for c in chat.PLAIN.controls)


WORDS = ["".join(random.Random(i).choice("abcdeéß日Z") for _ in range(1 + i % 5)) for i in range(150)]


def lexical_rows():
    r = random.Random(3)
    text = lambda n: " ".join(r.choices(WORDS, [1 / (1 + i) for i in range(len(WORDS))], k=n))
    docs = [(i, r.choice(["{}", "{},;{}", "-{}\x7f"]).format(text(r.choice([0, 1, 5, 40, 300])), text(3))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " \n.;"), (None, text(60)), (1003, docs[7][1]), (1003, docs[7][1]), (1004, "Zebra zEBRA zebra ÉCOLE école"), (1005, "w " * 700_000 + "rare")]
    items = [(i, text(r.choice([1, 4, 30]))) for i in range(40)] + [(100, None), (101, " .,"), (102, "nowhere"), (103, "ZEBRA École"), (103, "ZEBRA École"), (104, "rare w w"), (None, "zebra")]
    return docs, items


def brute_search(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(split(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in set(items):
        asked = Counter(split(text))
        found = [(sum(m * w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * s * n // total))) for t, m in asked.items() if t in c), d) for (d, c), s in zip(held, sizes, strict=True)]
        found = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(found)]
    return sorted(out, key=repr)


def test_lexical(spark, monkeypatch):
    docs, items = lexical_rows()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score long, TEXT string").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    wanted = brute_search(docs, items)
    got = lambda index, **o: sorted(map(tuple, lexical.search(index, asked, **o).collect()), key=repr)
    index = lexical.build(table, shard_terms=3000)
    assert index.shards.count() > 10 and got(index) == wanted
    assert got(index, k=3) == brute_search(docs, items, 3)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 400)
    assert got(lexical.build(table)) == wanted
    none = lexical.build(table.where("false"))
    assert got(none) == [] and lexical.search(index, asked.where("false")).count() == 0


def test_threshold_stops_early():
    """A document that stands first in all lists leaves most of them unread."""
    r = random.Random(5)
    common = [[f"t{j}".encode() for j in range(20) if r.random() < 0.5] + [b"x"] * r.randint(20, 400) for _ in range(3000)]
    rows = [[f"t{j}".encode() for j in range(20)] * 5] * 12 + common
    known: dict[bytes, int] = {}
    parts = [np.array([known.setdefault(w, len(known)) for w in row], np.int32) for row in rows]
    shard = lexical._Shard(lexical._shard(list(range(len(rows))), list(map(len, rows)), parts, known, len(rows), sum(map(len, rows))), dict.fromkeys((f"t{j}".encode() for j in range(20)), 1))
    asked = [(shard.place[f"t{j}".encode()], 1000) for j in range(20)]
    best, read = shard.best(asked, 10, [])
    assert [d for _, d in best] == list(range(10)) and len({s for s, _ in best}) == 1
    assert read < sum(len(set(x)) for x in rows) / 10
    assert shard.best(asked, 10, best)[1] <= read


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for i, text, lang, source, n in rows:
        leaf = H(*map(field, (i, source, lang, n, text)))
        if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        sources.setdefault(source, []).append((i, leaf, H(*map(field, (i, source, lang, n, text)))))

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([H(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
        return found

    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in sources[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for k, (i, leaf, now) in enumerate(sources[s]):
            siblings, h = [], now
            for tree, at in ((trees[s], k), (top, g)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    siblings += [x for j, x in enumerate(run) if j != at % 3]
                    run[at % 3] = h
                    h, at = H(*run), at // 3
            out.append((i, leaf, trees[s][-1][0], top[-1][0], H(*siblings), h, h == top[-1][0]))
    return sorted(out, key=repr)


def test_merkle(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, "", "one\nline", "é\n\n", "plain"]), r.choice([None, "en"]), "hot", r.choice([None, 3])) for i in range(2200)]
    rows += [(5000 + i, "alone\n", "en", s, 1) for i, s in enumerate([None, "", "a", "é", "Z", "a b", "1", "2", "3", "4", "5"])]
    rows += [(None, "no id\n", None, "n", 1), (None, "no id\n", None, "n", 1), (7000, "twice\n", "de", "n", 2), (7000, "twice\n", "de", "n", 2), (7000, "other", "de", "n", 2), (7001, "x\n" * 600_000, "de", "n", 2)]
    rows += [(9000 + i, f"{i}\n", "en", "s730", 1) for i in range(730)]
    table = lambda some: spark.createDataFrame([(*x, "y", 1) for x in some], "doc_id long, text string, lang string, source string, n_chars long, TEXT string, at long").repartition(5)
    got = sorted(map(tuple, merkle.manifest(table(rows)).collect()), key=repr)
    assert got == brute_manifest(rows)
    assert 0 < sum(not x[-1] for x in got) < len(got)
    assert sorted(map(tuple, merkle.manifest(table(rows[:1])).collect())) == brute_manifest(rows[:1])
    assert merkle.manifest(table(rows).where("false")).count() == 0


def test_row_groups_of_shards_are_small(spark):
    """A row group is held whole by tasks that write or read it, so it has few shards, however many a file has; and a writer keeps no values for statistics."""
    docs = spark.range(40).coalesce(1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 20000), i -> hex(xxhash64(id, i))), ' ') AS text")
    index = lexical.build(docs, shard_terms=20000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.shards.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert not any(m.row_group(0).column(c).is_stats_set for m in files for c in range(m.num_columns))
    assert sum(m.num_rows for m in files) == 40 and sum(sizes) > 30 << 20 and max(sizes) < 24 << 20  # a group ends at 8 MB compressed
