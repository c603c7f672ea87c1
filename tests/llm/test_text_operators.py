import random
import re

import pytest
import regex

from weir.llm import decontaminate, jaccard, language, licenses, line_dedup, toxicity, url_filter

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
say = lambda n: [rng.choice(VOCAB) for _ in range(n)]


def components(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- licenses
def licence_digest(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def licence_hits(text):
    w = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", (text or "").lower()).strip(" ") + " "
    if not any(g in w for g in licenses.GATES):
        return []
    hits = [(m.start(), -m.end(), -p, label) for label, k, x, p in licenses.rules() if k in w for m in re.finditer(x, w)]
    kept = []
    for s, e, p, label in sorted(hits):
        if kept and -e <= kept[-1][1]:
            continue
        if not kept or s >= kept[-1][1]:
            kept.append((s, -e, -p, label))
        elif -p > kept[-1][2]:
            kept[-1] = (s, -e, -p, label)
    return kept


def test_licenses(spark):
    texts = [None, "", "MIT License", "cc by cc-by, CC BY!", "the gnu\ngeneral public license; apache license", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License version 3 or Apache 2.0",
             "SPDX-License-Identifier: MIT\nx", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License. All rights reserved", "mit licenses apache licensed", "é cc by ü", "x " * 20000 + "mit license", "!!!"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(2, "MIT License", "q")], "doc_id long, text string, w string")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_digest(t), t
        hits = licence_hits(t)
        assert [(h.start, h.stop, h.p, h.label) for h in r.detections] == hits, t
        assert r.labels == ",".join(sorted({x for x in r.base_labels.split(",") if x} | {h[3] for h in hits}))
        assert 0 <= r.score <= 1
    assert len(licenses.rules()) > 200 and all(re.compile(x) for _, _, x, _ in licenses.rules())


def spellings(parsed):
    """A string for each way through an expression's branches and options."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "SUBPATTERN":
            more = spellings(arg[3])
        elif kind == "BRANCH":
            more = [x for branch in arg[1] for x in spellings(branch)]
        elif kind == "MAX_REPEAT":
            more = [""] * (arg[0] == 0) + [x * max(arg[0], 1) for x in spellings(arg[2])]
        elif kind == "IN":
            more = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg]
        else:
            more = {"LITERAL": [chr(arg)] if isinstance(arg, int) else [], "NOT_LITERAL": ["q"], "ASSERT": [""]}[kind]
        out = [x + y for x in out for y in more]
    return out


def test_license_keywords_and_gates_lose_nothing(spark):
    from re import _parser

    for label, keyword, expression, _ in licenses.rules():
        for x in spellings(_parser.parse(expression)):
            assert re.search(expression, f" {x} ") and keyword in f" {x} " and any(g in x for g in licenses.GATES), (label, x)
    texts = {"BSD Zero Clause License": "bsd-0", "The Beer-Ware License": "beerware", "PSF License": "python", "MIT No Attribution": "mit-0", "Two Clause License": "bsd-2", "BSD-style license": "bsd", "OpenSSL Toolkit License": "openssl"}
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


# -- decontamination
def edits(a, text):
    """Least word edit distance of a to any piece of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    items = [(0, " ".join(say(20))), (1, " ".join(say(9))), (2, " ".join(say(3))), (3, None), (4, "!!"), (5, "one")]
    items.append((6, items[0][1]))
    docs = [(0, None), (1, ""), (2, "one")]
    for k in range(60):
        w = say(30)
        a = items[rng.randrange(3)][1].split()
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(a))
            a = rng.choice([a[:p] + a[p + 1 :], a[:p] + ["zz"] + a[p:], a[:p] + ["zz"] + a[p + 1 :]]) or ["zz"]
        docs.append((10 + k, " ".join(w[:15] + a + w[15:])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(d, b).collect()}
    for i, t in docs:
        for j, x in items:
            a, w = decontaminate.words(x), decontaminate.words(t)
            dist = edits(a, w) if a else 99
            hit = bool(a and w) and dist <= int(0.2 * len(a))
            assert ((i, j) in got) == hit, (i, j, dist)
            if hit:
                r = got[i, j]
                assert r.distance == dist and edits(a, w[r.start_word : r.end_word]) == dist
    kept = {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.decontaminate(d, b.limit(0)).count() == len(docs)


# -- line dedup
def test_line_dedup(spark):
    base = [" ".join(say(rng.randint(12, 30))) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, "short line\nshort line"), (None, base[0])]
    for i in range(3, 40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            lines.append((" ".join(w)).capitalize() + rng.choice([".", "!", ""]))
        docs.append((i, "\n".join(lines)))
    docs.append((39, docs[-1][1]))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, _key int, n_gone string")
    norm = lambda s: regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub("[1-9]", "0", s.lower())).strip(" ")
    marks = {(r.doc_id, r.t): r.m for r in df.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) m").collect()}
    places = {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if len((z := norm(line)).split()) >= 5:
                places.setdefault(z, []).append(((i is not None, i or 0, marks[i, t or ""], n), (i, t, n)))
    assert set(places) == {r.norm for r in line_dedup.lines_of(df).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    names = sorted(places)
    pairs = [(a, b) for a in names for b in names if a < b and distance(a, b) <= max(len(a), len(b)) * 20 // 100]
    assert pairs, "the fixture has fuzzy links"
    comp, keep = components(names, pairs), set()
    for c in set(comp.values()):
        keep.add(min(x for n in names if comp[n] == c for x in places[n])[1])
    lost = {}
    for n in names:
        for _, (i, t, k) in places[n]:
            if (i, t, k) not in keep:
                lost.setdefault((i, t), set()).add(k)
    for r in line_dedup.dedup(df).collect():
        olds = [t for i, t in docs if i == r.doc_id]
        wanted = [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost.get((r.doc_id, t), ())) for t in olds]
        assert r.text in wanted
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_short_copied_lines_go(spark, tmp_path):
    """The query and the pipeline's stage take exact copies of short lines, also without spaces."""
    long = "one two three four five six"
    docs = [(1, f"All rights reserved.\n{long}\n\u4e00\u4e8c\u4e09"), (2, "all rights reserved\n--\nnew words"), (3, "\u4e00\u4e8c\u4e09!\nNEW WORDS\n--"), (4, f"{long}\nall rights reserved"), (5, "!!\n")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_gone) for r in line_dedup.op6(spark, str(tmp_path)).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("--\nnew words", 1), 3: ("--", 2), 4: ("", 2), 5: ("!!\n", 0)}
    assert {r.doc_id: r.text for r in line_dedup.strip(df).collect()} == {i: got[i][0] for i in (1, 2, 3, 5)}


def test_one_word_edits_are_found(spark):
    """Recall of lines with one word changed, by length; unrelated lines stay."""
    docs, found = [], 0
    for n in (8, 12, 20, 40, 120):
        for k in range(40):
            w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]
            docs.append((len(docs), " ".join(w)))
            at = min(range(n), key=lambda i: (len(w[i]) > 6, rng.random()))  # within the budget of edits
            w[at] = w[at][::-1] + "x"
            docs.append((len(docs), " ".join(w)))
    for n in (8, 30):
        docs += [(len(docs) + k, " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))) for k in range(20)]
    got = {r.doc_id: r.n_gone for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(1, 400, 2)) >= 0.98 * 200
    assert sum(v for i, v in got.items() if i % 2 == 0 or i >= 400) == 0


def test_edits_of_several_long_words_are_found(spark):
    """Lines keep a link if two of their five longest words are changed; by words, lines of more than
    LONG characters do whatever their lengths in characters."""
    pick = random.Random(11)
    word = lambda low, high: "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(low, high)))
    docs = []
    for n in (10, 20, 40):
        for k in range(30):
            w = [word(7, 12) for _ in range(5)] + [word(2, 6) for _ in range(n - 5)]
            order, changed = pick.sample(range(n), n), pick.sample(range(5), 2)
            docs.append([w[i] for i in order])
            docs.append([w[i][:2] + "q" + w[i][3:] if i in changed else w[i] for i in order])
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    w = [word(14, 16) for _ in range(6)] + [word(2, 3) for _ in range(194)]
    long = [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:6] + ["".join(chr(114 + (i * j) % 8) for j in range(1, 7)) for i in range(30)] + w[36:]))]
    assert len(long[0][1]) > line_dedup.LONG and len(long[0][1]) * 100 < len(long[1][1]) * 90
    got = {r.doc_id: r.n_gone for r in line_dedup.dedup(spark.createDataFrame(rows + long, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [0, 1] * 90 and got[len(rows) + 1] == 1


def test_texts_wanted_by_bitmap(spark):
    rows = spark.range(-3000, 3000).selectExpr("xxhash64(id) k1", "id")
    named = rows.where("id % 7 = 0").select("k1")
    got = {r.id for r in line_dedup._among(rows, named).collect()}
    assert set(range(-2996, 3000, 7)) <= got and len(got) < 900


def test_only_keys_and_texts_of_pairs_are_shuffled(spark, monkeypatch):
    """A row a key is two numbers when it is dealt out; of the texts those of pairs go, the first
    side's not at all. Beyond what may be broadcast, bitmaps choose them and links are the same."""
    from weir.llm.common import Scratch

    def dealt(df):
        """The columns of each shuffle."""
        todo, found = [df._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                todo.append(node.initialPlan())
                continue
            if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                found.append(sorted(node.output().apply(i).name() for i in range(node.output().size())))
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found

    asked, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: asked.append(dealt(df)) or table(self, df))
    cls = spark.createDataFrame([(i, *[1000 * (i // 2) + k for k in range(5)]) for i in range(20)], "id long, w0 long, w1 long, w2 long, w3 long, w4 long")
    posts = line_dedup.posts_of(cls, Scratch(spark))
    assert sorted((r.id, r.lo) for r in posts.collect()) == [(i, i // 2 * 2) for i in range(20)]
    assert asked[0] == [["id", "key"]]
    monkeypatch.undo()
    texts = spark.createDataFrame([(i, f"one two three four five six seven eight {i // 2}") for i in range(200)], "id long, norm string")
    pairs = spark.createDataFrame([(0, 1), (0, 150), (4, 5), (6, 90)], "a long, b long")
    wanted = [(0, 1), (0, 150), (4, 5), (6, 90)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = line_dedup._similar(pairs, texts, 80)
        assert ["a", "s"] not in dealt(near) and ["b", "t"] in dealt(near)
        assert "LeftSemi" in near._jdf.queryExecution().toString()
        assert sorted((r.a, r.b) for r in near.collect()) == wanted
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
        assert sorted((r.a, r.b) for r in line_dedup._similar(pairs, texts, 80).collect()) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    docs = [(i, f"{line}\nall rights reserved") for i, line in enumerate(["a line of words that are alike", "a line of words that are alike!", "a line of words that were alike", "nothing else is as this one"])]
    got = {r.doc_id: r.n_gone for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), short=True).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 1}


def test_lines_with_a_common_passage(spark, monkeypatch):
    """Unlike lines that share their longest words: all their pairs are compared, in several blocks,
    but few of them are rows. Links as by brute force."""
    pick = random.Random(12)
    word = lambda low, high: "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(low, high)))
    passage, tails = [word(9, 12) for _ in range(7)], [[word(2, 7) for _ in range(pick.choice((20, 24, 110)))] for _ in range(130)]
    for i in range(0, 20, 2):
        tails[100 + i] = tails[i][: len(tails[i]) - 1] + [word(2, 4)]
    lines = [" ".join(t + passage) for t in tails]
    asked, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *rest: asked.append(pairs.count()) or similar(pairs, *rest))
    for name, value in (("HOT", 16), ("BLOCK", 30)):
        monkeypatch.setattr(line_dedup, name, value, raising=False)
    got = {r.doc_id: r.n_gone for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: int(100 <= i < 120 and i % 2 == 0) for i in range(130)}
    assert sum(asked) < 10 * len(lines)


def test_links_of_hot_keys_are_forests(spark, monkeypatch):
    """Near copies that are all apart yet, under keys of many classes: links join what brute force
    joins, and there are fewer than members of cells, not all similar pairs."""
    pick = random.Random(13)
    word = lambda low, high: "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(low, high)))
    base, texts = [[word(4, 8) for _ in range(n)] for n in (12, 16, 120)], {}
    for i in range(90):
        w = list(base[i % 3])
        w[pick.randrange(len(w))] = word(3, 4)
        texts[i] = " ".join(w if i < 84 else [word(4, 8) for _ in range(14)])
    keys = {1: list(range(90)), 2: list(range(0, 90, 2))}
    joined = {i: 0 if i % 3 == 0 and i < 60 else i for i in texts}  # 20 are one component before
    placed = spark.createDataFrame([(k, i, len(m), joined[i]) for k, m in keys.items() for i in m], "key long, id long, c long, component long")
    for name, value in (("HOT", 16), ("BLOCK", 8)):
        monkeypatch.setattr(line_dedup, name, value)
    got = [(r.a, r.b) for r in line_dedup._hot(placed, spark.createDataFrame(list(texts.items()), "id long, norm string"), 80).collect()]
    pairs = [(a, b) for a in texts for b in texts if a < b < 84 and a % 3 == b % 3]
    assert {(a, b) for a, b in got} <= set(pairs) and not any(joined[a] == joined[b] for a, b in got)
    before = [(0, i) for i in texts if joined[i] == 0 and i]
    assert components(list(texts), got + before) == components(list(texts), pairs)
    assert len(got) < len(pairs) // 2


def test_small_components_are_one_file(spark):
    """Labels are written by their number, not a file a task; chains keep their components."""
    from weir.llm.common import Scratch, components

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a long, b long"), Scratch(spark))
        assert {r.id: r.component for r in got.collect()} == {i: i // 20 * 20 for i in range(60)}
        assert len(got.inputFiles()) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_strip_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a line of five words", 77, 88), (2, "a line of five words", 77, 88), (3, None, 1, 2), (4, "v" * 300_000, 1, 2), (4, "v" * 300_000, 1, 2), (None, "x", None, None)], "doc_id long, text string, n_lines int, n_gone int")
    got = sorted(((r.doc_id, r.text and len(r.text), r.n_lines, r.n_gone) for r in line_dedup.strip(df).collect()), key=str)
    assert got == sorted([(1, 20, 77, 88), (3, None, 1, 2), (4, 300_000, 1, 2), (4, 300_000, 1, 2), (None, 1, None, None)], key=str)
    assert line_dedup.strip(df.limit(0)).collect() == []


# -- jaccard
def test_jaccard(spark):
    docs = [(0, None), (1, ""), (2, "  \n"), (3, "two words"), (4, "Two  Words"), (5, "two words more"), (None, "two words")]
    for i in range(6):
        base = say(rng.randint(30, 80))
        for k in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            docs.append((100 + 20 * i + k, rng.choice([" ", "\n", "  "]).join(w).title()))
    docs.append(docs[-1])
    sets = {}
    for i, t in docs:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(sets, pairs)
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, n int").repartition(3)
    rows = jaccard.groups(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == {i for i in sets if comp[i] == i} | {None}
    assert jaccard.groups(df.limit(0)).count() == 0


def test_jaccard_sql(spark):
    import duckdb

    with duckdb.connect() as db:
        db.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
        want = db.execute(jaccard.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in jaccard.op10(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and any(a != c for a, _, c in got)


def test_bitmaps_bound_differences():
    for n in (1, 40, 1500, 70_000):
        a = jaccard.np.random.default_rng(n).integers(0, 1 << 63, n, "uint64")
        b = jaccard.np.r_[a[: n // 2], a[: n // 3] ^ jaccard.np.uint64(1)]
        x, y = jaccard.bitmap(jaccard.np.unique(a)), jaccard.bitmap(jaccard.np.unique(b))
        words = min(len(x), len(y)) // 8
        apart = int(jaccard.np.bitwise_count(jaccard.folded(x, words) ^ jaccard.folded(y, words)).sum())
        assert apart <= len(jaccard.np.setxor1d(a, b))


def test_keep_one_keeps_one_row(spark):
    t, rows = "one two three four five six seven", [(1, "b"), (2, None), (2, None), (None, "x"), (None, "x"), (3, ""), (3, "")]
    docs = [(5, t, "p"), (5, t, "p"), (5, t + "!", "q"), (7, t, "r"), *[(i, x, "s") for i, x in rows]]
    got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(docs, "doc_id long, text string, row string")).collect()]
    assert sorted(got, key=str) == sorted([(5, t, "p"), *[(i, x, "s") for i, x in rows]], key=str)
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string, row string")).count() == 0


@pytest.mark.parametrize("light", [0, 3, 32])
def test_frequent_tokens_lengthen_prefixes(spark, monkeypatch, light):
    """With every token frequent, all prefixes lengthened, and entities compared in blocks, the links
    are the same. Copies here differ by words that are left out, so most pairs stay just short of a link."""
    for name, value in (("FREQUENT", 2), ("COST_STEP", 2), ("LIGHT", light), ("BLOCK", 7), ("PIVOT_ROUNDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    base = say(120)
    docs = []
    for i in range(60):
        w = [x for x in base if rng.random() > (i % 5) / 60]
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        docs.append((i, " ".join(w)))
    s = {i: jaccard.shingles(t) for i, t in docs}
    comp = components(s, [(a, b) for a in s for b in s if a < b and jaccard.linked(s[a], s[b])])
    got = {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == comp


# -- language
def test_language(spark):
    stems = {"aa": ["foka", "tokim", "lokan"], "bb": ["zirre", "wixel", "ripple"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "s"]) for _ in range(30)), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "", None), (502, "123 !?", "bb"), (503, " ".join(["fokas"] * 700), None), (None, "zirre wixel", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, t, lang in rows[:120])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert got[503].n_words == 700 and got[503].lang_pred == "aa" and got[None].lang_pred == "bb"
    model = language.fit([(t, lang) for _, t, lang in rows[:120]])
    tags = language.Labeller(model).posteriors(["foka tokim lokan zirre wixel ripple"])[0].argmax(1).tolist()
    assert tags == [0, 0, 0, 1, 1, 1]
    assert {r.doc_id for r in language.accept(df).collect()} == set(got) - {500, 501, 502}
    assert language.identify(df.limit(0)).count() == 0


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    g = np.random.default_rng(3)
    e, m = g.random((1, 4, 3)), g.random((3, 3))
    post, _ = language._forward_backward(e, m)
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = np.prod([e[0, i, y] for i, y in enumerate(path)]) * np.prod([m[a, b] for a, b in zip(path, path[1:])])
        for i, y in enumerate(path):
            want[i, y] += p
    assert np.allclose(post[0], want / want.sum(1, keepdims=True))


def test_long_texts_are_one_chain():
    import numpy as np

    g = np.random.default_rng(4)
    words = [f"w{'abcdefghij'[i]}x" for i in range(10)]
    model = language.fit([(" ".join(words[:5] * 8), "aa"), (" ".join(words[5:] * 8), "bb"), (" ".join(words[3:8] * 8), "cc")], rounds=2)
    model.transitions = np.log(g.random((3, 3)) ** 3 + 1e-3)
    texts = [" ".join(g.choice([*words, "7"], n)) for n in (3, 255, 256, 257, 512, 1100, 40)] + [""]
    use = language.Labeller(model)
    got = use.posteriors(texts)
    for ids, post in zip(use.encode(texts), got):
        if len(ids):
            want = language._forward_backward(use.e[ids][None].astype("float64"), np.exp(model.transitions))[0][0]
            want[ids == 0] = 0
            assert np.allclose(post, want, atol=1e-4)


def test_long_tokens_count_whole():
    assert language.words_of("a" * 40 + " b") == ["a" * 40, "b"]
    assert language.words_of("x" * 95 + " b") == ["x" * 40, "x" * 40, "x" * 15, "b"]
    model = language.fit([(" ".join(["foka"] * 60), "aa"), (" ".join(["zirre"] * 60), "bb")])
    paragraph = "foka" * 5 + "zirre" * 400 + "foka" * 5
    assert language.Labeller(model).documents([paragraph])[0][0] == "bb"


# -- toxicity
def test_toxicity(spark):
    rows, labels = [], []
    for i in range(400):
        w = say(60)
        if i % 4 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["quizzword", "jinxterm", "vexlabel"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (None, "abc")]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(d, y).collect()}
    assert len(got) == len(rows) and got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    held = [(r.predicted, i % 4 == 0) for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert toxicity.classify(d, y.limit(0)).count() == len(rows)


def test_toxic_dictionary_holds_weak_words():
    """A rarer language's telling words are learned beside far stronger ones, and count."""
    own = random.Random(8)
    strong, weak = [f"{a}{a}loud" for a in "ijklmnopqrst"], [f"{a}{a}soft{b}" for a in "uvwxyz" for b in "ijklmn"]
    text = lambda extra: " ".join(own.sample([own.choice(VOCAB) for _ in range(50)] + extra, 50 + len(extra)))
    rows = [(text([]), 0) for _ in range(1200)] + [(text(own.sample(strong, 10)), 1) for _ in range(250)] + [(text(own.sample(weak, 8)), 1) for _ in range(40)]
    model = toxicity.fit(rows)
    assert all(f" {w}".encode() in model.toxic for w in strong) and all(f" {a}{a}soft".encode() in model.toxic for a in "uvwxyz")
    s = toxicity.Scorer(model)
    assert sum(s.score(text(own.sample(weak, 8))) >= toxicity.THRESHOLD for _ in range(30)) >= 24
    assert sum(s.score(text([])) >= toxicity.THRESHOLD for _ in range(100)) <= 3


# -- url filter
def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    pages = [
        (0, "http://A.Example.ORG/es/1?q#f", link("plain.net")), (1, "https://example.org/en/12", None), (2, "https://example.org/en/2", ""), (3, "ftp://x.com/fr/", "x"), (4, "//no/scheme", None), (5, None, link("x")),
        (6, "http://bad.com/de/x", link("near.net")), (7, "http://spam.net/a", link("bad.com")), (8, "http://plain.net", link("/rel")), (9, "http://notorg/", None), (10, "http://org", None), (11, "http://far.net/q", link("spam.net")), (11, "http://far.net/q", link("spam.net")),
    ]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    rows = url_filter.judge(df).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    seen = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert seen[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and seen[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert seen[2] == ("example.org", "/en/2", "org/", "allow") and seen[3] == ("x.com", "/fr/", "com/fr/", "allow") and seen[4] == ("", "", None, "allow") and seen[5] == ("", "", None, "allow")
    assert seen[6][2:] == ("com/de/", "block") and seen[9][2] is None and seen[10] == ("org", "", None, "allow")
    assert seen[7][3] == "block" and seen[11][3] == "block" and seen[8][3] == "allow"
    # brute force of the scores
    edges = {("a.example.org", "plain.net"): 1, ("bad.com", "near.net"): 1, ("spam.net", "bad.com"): 1, ("plain.net", "plain.net"): 1, ("far.net", "spam.net"): 2}

    def rank(edges, seeds):
        total, out = sum(seeds.values()), {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        start = {h: w / total for h, w in seeds.items()}
        score = dict(start)
        for _ in range(url_filter.ROUNDS):
            new = {h: 0.15 * w for h, w in start.items()}
            for (a, b), n in edges.items():
                new[b] = new.get(b, 0) + 0.85 * score.get(a, 0) * n / out[a]
            score = new
        return score

    distrust = rank({(b, a): n for (a, b), n in edges.items()}, {"a.example.org": 1, "example.org": 0.5, "bad.com": 1})
    trust = rank(edges, {"example.org": 0.5, "x.com": 1})
    for r in rows:
        assert r.distrust == pytest.approx(distrust.get(r.host, 0)) and r.trust == pytest.approx(trust.get(r.host, 0))


def test_url_verdicts_hold_in_large_tables(spark):
    """One link pattern, once and over many thousand hosts, gets the same verdicts."""
    verdicts = []
    for n in (1, 12_000):
        page = lambda k, host, path, to: spark.range(n).selectExpr(f"{k} + 10 * id page_id", f"concat('http://{host}', id, '{path}') url", f"concat('<a href=\"http://{to}', id, '.com/\">') html")
        pages = page(0, "bad", ".com/de/x", "bad").union(page(1, "bad", ".com/x", "bad")).union(page(2, "near", ".net/x", "bad")).union(page(3, "good", ".com/fr/x", "fine")).union(page(4, "fine", ".com/x", "fine"))
        got = url_filter.judge(pages).selectExpr("page_id % 10 kind", "verdict").groupBy("kind", "verdict").count().collect()
        assert all(r["count"] == n for r in got)
        verdicts.append({r.kind: r.verdict for r in got})
    assert verdicts[0] == verdicts[1] == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_registered(spark):
    import __spark_entry__ as e
    import corpus_pipeline

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert len(names) == 10 and "pipeline" in e.queries() and [n for n, _ in corpus_pipeline.STAGES][0] == "language"


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 50
