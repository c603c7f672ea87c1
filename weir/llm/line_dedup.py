"""Fuzzy line deduplication.

Native: DataFrame functions only. Lines are normalised to words (case, punctuation, digits); equal
ones are one class. The fingerprint of a class has BLOCKS blocks, the hashes of its longest distinct
words (a fixed order: length, then hash). Whatever changes BLOCKS - AGREE words of a line leaves
AGREE blocks as they were (pigeonhole), so every choice of AGREE blocks is a join key. Pairs that may
join two groups are verified by edit similarity, and the first occurrence of a connected group, by
doc_id and line, stays. Pairs that don't share AGREE blocks are not found, however similar: more than
BLOCKS - AGREE of the longest words are changed, as a letter in each word does at an edit similarity
of 0.8.

The fingerprint takes the place of a 64-bit SimHash, which can't give right results here: a word
changed in a line of n turns about 64 arccos(1 - 1/n) / pi of its bits (10 at 8 words, 6 at 20, 5 at
40), and keys of 20 bits, which it takes to tell a million lines apart, survive that in 3 %, 12 % and
23 % of such pairs: some 75, 18 and 9 keys a line for nine pairs of ten. Here BLOCKS over AGREE keys
find all of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import BROADCAST_ROWS, Scratch, components, fresh, small

#: Shorter lines take no part in fuzzy links; of exact copies they do if asked for.
LEAST_WORDS = 5
#: Blocks of a fingerprint, and how many of them two lines share that are compared.
BLOCKS, AGREE = 5, 3
#: Characters from which words are ranked alone, where a line has BLOCKS of them.
LONG_WORD = 7
PERCENT = 80
#: Lines of more characters are compared by words: the cost grows with the square of the length.
LONG = 512
STAR_ROUNDS = 2
#: Keys of more classes that are still apart are compared inside tasks, in squares of blocks of BLOCK.
HOT, BLOCK = 32, 128
#: Bits of the bitmap of classes whose texts are wanted, 2 ** MAP_BITS / 8 bytes to each executor.
MAP_BITS = 26
#: What parts words besides spaces, and becomes one: all of Latin-1 but line breaks, letters and
#: digits (each by itself: a class without ranges is one table look-up a character); and the blocks
#: of typographic and East Asian punctuation.
_OTHERS = "".join(f"\\x{i:02X}" for i in range(0xC0) if not (chr(i).isascii() and chr(i).isalnum() or chr(i) in " \n")) + r"\xD7\xF7"
_SIGNS = r"\x{2000}-\x{206F}\x{3000}-\x{303F}"
#: A run of them and of spaces, but not a single space, in one pass; for ASCII, and for any text.
_PARTS, _ALL_PARTS = (f"[{x} ](?:[{x} ]+|(?<=[{x}]))" for x in (_OTHERS, _OTHERS + _SIGNS))


def lines_of(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, mark, line_no, norm, k1, k2, w0, w1 ..: the lines that count, 128 bits of their class
    and their fingerprint. With short, those are all that hold a letter or digit; the fingerprint
    of lines of fewer than LEAST_WORDS words is null.

    mark tells apart rows with one doc_id by their text; rows alike in both are one document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.lower(F.regexp_replace(text, "[1-9]", "0"))
    clean = F.when(F.octet_length(text) == F.length(text), F.regexp_replace(clean, _PARTS, " ")).otherwise(F.regexp_replace(clean, _ALL_PARTS, " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(clean, "\n", -1)).alias("line_no", "line"))
    rows = rows.select("doc_id", "mark", "line_no", F.trim("line").alias("norm")).where(F.col("norm") != "")
    rows = once(rows, "doc_id", "mark", "line_no", "norm", words=F.split("norm", " "))
    many = F.size("words") >= LEAST_WORDS
    if not short:
        rows = rows.where(many)
    # most lines have enough long words; only those are ranked then
    ranked = lambda words: F.array_distinct(F.transform(words, _rank))
    rows = once(rows, "doc_id", "mark", "line_no", "norm", "words", ranks=F.when(many, ranked(F.filter("words", lambda w: F.length(w) >= LONG_WORD))))
    blocks = F.slice(F.sort_array(F.when(F.size("ranks") >= BLOCKS, F.col("ranks")).otherwise(ranked(F.col("words"))), False), 1, BLOCKS)
    rows = once(rows, "doc_id", "mark", "line_no", "norm", blocks=F.when(F.col("ranks").isNotNull(), blocks))
    return rows.select("doc_id", "mark", "line_no", "norm", F.xxhash64("norm").alias("k1"), F.xxhash64("norm", F.lit(17)).alias("k2"), *[F.get("blocks", F.lit(i)).alias(f"w{i}") for i in range(BLOCKS)])


def once(df: DataFrame, *names: str, **columns: Column) -> DataFrame:
    """The columns named and computed ones: by a generator, so that what reads them later doesn't
    compute them again."""
    return df.select(*names, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _rank(word: Column) -> Column:
    """A word's place in the order of blocks: its length, then its hash."""
    return F.shiftleft(F.length(word).cast("long"), 48).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 16))


def keys(cls: DataFrame) -> DataFrame:
    """id, key: a row for each choice of AGREE blocks. A line of fewer distinct words has fewer."""
    each = [F.when(F.col(f"w{c[0]}").isNotNull(), F.xxhash64(*[f"w{i}" for i in c])) for c in combinations(range(BLOCKS), AGREE)]
    return cls.where("w0 is not null").select("id", F.explode(F.array_distinct(F.array(*each))).alias("key")).where("key is not null")


def posts_of(cls: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, lo, c: the classes of each key that several have, its smallest id and their number.
    Of keys with the same classes, whose pairs are the same, there is one."""
    w = Window.partitionBy("key")
    # sets of classes are told apart by sums of hashes of their ids
    marks = [F.bit_xor(F.xxhash64("id")).over(w).alias("h1"), F.sum(F.shiftright(F.xxhash64("id", F.lit(17)), 32)).over(w).alias("h2")]
    # most keys have one class; their rows go before the other sums, which need no further sort
    met = keys(cls).select("key", "id", F.count(F.lit(1)).over(w).alias("c")).where("c > 1")
    met = scratch.table(met.select("key", "id", "c", F.min("id").over(w).alias("lo"), *marks))
    one = met.where("id = lo").groupBy("c", "lo", "h1", "h2").agg(F.min("key").alias("key"))
    posts = scratch.table(met.select("key", "id", "lo", "c").join(one.select("key"), "key", "left_semi"))
    scratch.drop(met)
    return posts


def _placed(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """key, id, c and component of posts, under the keys that hold several components, and the ends
    lo and hi of those keys by component."""
    p = posts.select("key", "id", "c").join(small(comp, comp.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # a component a row and key is enough to know a key's ends; min and max of pairs as two longs each
    ends = p.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return p.join(ends, "key")


def _stars(placed: DataFrame) -> DataFrame:
    """a < b: for each class and key a member of the key's lowest component, or of its highest if the
    class is of the lowest itself."""
    picks = placed.groupBy("key").agg(F.min(F.when(F.col("component") == F.col("lo"), F.col("id"))).alias("lo_id"), F.max(F.when(F.col("component") == F.col("hi"), F.col("id"))).alias("hi_id"))
    pick = F.when(F.col("component") != F.col("lo"), F.col("lo_id")).otherwise(F.col("hi_id"))
    return placed.join(picks, "key").select(F.least("id", pick).alias("a"), F.greatest("id", pick).alias("b")).distinct()


def _open(placed: DataFrame) -> DataFrame:
    """a < b: all pairs of classes of different components that share a key of at most HOT classes."""
    placed = placed.where(F.col("c") <= HOT)
    p = placed.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    q = placed.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    return p.join(q, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()


def _hot(placed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a < b: links that join all classes of different components that are similar and share a key of
    more than HOT, in each cell a forest.

    All of a key's pairs are compared, each under the smallest key it shares, but none is a row: the
    classes are dealt into blocks by component, two blocks meet in a row, a cell, and its pairs are
    formed and verified by higher-order functions. Pairs that links of the cell, or components, join
    already are left out, so a cell of n classes gives n - 1 links at most, however alike they are. A
    class goes to as many rows as its key has blocks; blocks of one component don't meet."""
    key = Window.partitionBy("key")
    hot = placed.where(F.col("c") > HOT).select("key", "id", "component")
    shared = hot.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("shared"))  # at most a number of keys that BLOCKS and AGREE fix
    own = _among(texts, hot, F.xxhash64("id")).join(shared, "id").select("id", "shared", F.length("norm").alias("n"), F.size(F.split("norm", " ")).alias("words"), _longest(F.split("norm", " "), F.array().cast("array<string>")).alias("most"), "norm", _letters(F.split("norm", " ")).alias("letters"))
    own = own.withColumn("norm", F.when(F.col("n") <= LONG, F.col("norm")))  # of longer ones only words are compared
    # the places of a component within a key are consecutive, from start
    places = {"place": F.row_number().over(key.orderBy("component", "id")) - 1, "start": F.rank().over(key.orderBy("component")) - 1, "size": F.count(F.lit(1)).over(Window.partitionBy("key", "component")), "top": F.floor((F.count(F.lit(1)).over(key) - 1) / BLOCK).cast("int")}
    dealt = hot.withColumns(places).withColumns({"block": F.floor(F.col("place") / BLOCK).cast("int"), "at": F.col("place") % BLOCK, "one": F.ceil(F.col("start") / BLOCK), "last": F.floor((F.col("start") + F.col("size")) / BLOCK) - 1})
    within = lambda block: block.between(F.col("one"), F.col("last"))
    others = F.filter(F.sequence(F.lit(0), F.col("top")), lambda other: ~(within(F.col("block")) & within(other)))
    each = dealt.join(own, "id").select("key", "block", F.struct("at", "id", "component", "shared", "n", "words", "most", "norm", "letters").alias("m"), F.explode(others).alias("other"))
    low = F.col("block") <= F.col("other")
    each = each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # a number of tasks is given: by bytes, adaptive execution would put all into a few
    cell = each.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "key", "i", "j").groupBy("key", "i", "j").agg(F.collect_list(F.when(low, F.col("m"))).alias("u"), F.collect_list(F.when(~low, F.col("m"))).alias("v"))
    cell = once(cell, "key", "i", "j", u=F.sort_array("u"), v=F.sort_array(F.when(F.col("i") < F.col("j"), F.col("v")).otherwise(F.col("u"))))

    def near(x: Column, y: Column) -> Column:
        long = F.greatest(x.n, y.n) > LONG
        most = lambda a, b: F.floor(F.greatest(a, b) * (100 - percent) / 100).cast("int")
        like = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
        lev = lambda a, b, budget: F.call_function("levenshtein", a, b, budget) >= 0
        # as in _similar(): a word turned costs so many characters at most
        few = F.floor(most(x.n, y.n) / (F.greatest(x.most, y.most) + 1)).cast("int")
        by_words = lev(x.letters, y.letters, most(x.words, y.words))
        by_letters = lev(x.letters, y.letters, few) | lev(x.norm, y.norm, most(x.n, y.n))
        first = F.array_min(F.array_intersect(x.shared, y.shared)) == F.col("key")
        sized = F.when(long, like(x.words, y.words)).otherwise(like(x.n, y.n))
        return sized & first & F.when(long, by_words).otherwise(by_letters)

    # labels: of the cell's members, u then v, what joins them; members that are joined have one label
    shift = F.when(F.col("i") < F.col("j"), F.size("u")).otherwise(0)

    def step(state: Column, x: Column, y: Column) -> Column:
        ours, theirs = F.get(state.labels, x["at"]), F.get(state.labels, y["at"] + shift)
        labels = F.transform(state.labels, lambda label: F.when(label == theirs, ours).otherwise(label))
        pair = F.struct(F.least(x.id, y.id).alias("a"), F.greatest(x.id, y.id).alias("b"))
        met = ((F.col("i") < F.col("j")) | (x["at"] < y["at"])) & (ours != theirs) & near(x, y)
        return F.when(met, F.struct(labels.alias("labels"), F.concat(state.links, F.array(pair)).alias("links"))).otherwise(state)

    labels = F.transform(F.when(F.col("i") < F.col("j"), F.concat("u", "v")).otherwise(F.col("u")), lambda m: m.component)
    none = F.struct(labels.alias("labels"), F.array().cast("array<struct<a: bigint, b: bigint>>").alias("links"))
    forest = F.aggregate("u", none, lambda state, x: F.aggregate("v", state, lambda state, y: step(state, x, y)))
    return cell.select(F.inline(forest.links))


def _among(rows: DataFrame, named: DataFrame, hashed: Column | None = None) -> DataFrame:
    """The rows whose k1 (or hashed, 64 bits of columns that both have) is one of named, and a few
    others: by a bitmap of its first MAP_BITS bits, in pieces of 4096 bytes, so that the rest of a
    large table isn't shuffled."""
    bits = F.shiftrightunsigned(F.col("k1") if hashed is None else hashed, 64 - MAP_BITS)
    piece, bit = F.shiftright(bits, 15).cast("int"), bits.bitwiseAND(F.lit(32767))
    maps = named.select(piece.alias("piece"), bit.alias("bit")).repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring(F.col("map"), F.shiftright(bits.bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), bits.bitwiseAND(F.lit(7)))), F.lit(2)) == 1
    return rows.withColumn("piece", piece).join(F.broadcast(maps), "piece").where(held).select(*rows.columns)


def links(lines: DataFrame, cls: DataFrame, scratch: Scratch, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links a, b and components id, component of classes whose normalised lines have edit
    similarity of percent / 100 or more and share a key. lines: as lines_of() gives them; cls: id, k1,
    k2, w0 ..

    A key's first member is compared with all others; then STAR_ROUNDS - 1 times each class with a
    member of another component; then all pairs of components that are still apart, those of hot
    keys inside tasks. So a group of n copies costs n comparisons, and links are left out only where
    they would join what is joined, those of hot keys too. n classes of one key that are no copies cost n * n / 2."""
    posts = posts_of(cls, scratch)
    tried = scratch.table(posts.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct())
    wanted = scratch.table(posts.select("id").distinct())
    named = cls.select("id", "k1", "k2").join(small(wanted, n := wanted.count()), "id")
    rows = lines.select("k1", "k2", "norm")
    rows = rows if n <= BROADCAST_ROWS else _among(rows, named)
    texts = scratch.table(rows.join(small(named, n), ["k1", "k2"]).groupBy("id").agg(F.min("norm").alias("norm")))
    good = scratch.table(_similar(tried, texts, percent))
    comp = components(good, scratch)
    for step in range(1, STAR_ROUNDS + 1):
        placed = scratch.table(_placed(posts, comp))
        last = step == STAR_ROUNDS
        pairs = _open(placed) if last else _stars(placed)
        fresh_pairs = scratch.table(pairs.join(tried, ["a", "b"], "left_anti"))
        found = [_similar(fresh_pairs, texts, percent)] if not fresh_pairs.isEmpty() else []
        if last and not placed.where(F.col("c") > HOT).isEmpty():
            found.append(_hot(placed, texts, percent))
        if found:
            tried = tried.union(fresh_pairs)
            more = [scratch.table(f) for f in found]
            # a component's links so far count as a star, so that a round starts from labels that are settled
            joins = comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
            for m in more:
                good, joins = good.union(m), joins.union(m)
            old, comp = comp, components(joins, scratch)
            scratch.drop(old)
        scratch.drop(placed)
    scratch.drop(posts, wanted, texts, tried)
    return good, comp


def _letters(words: Column) -> Column:
    """One character for each word, of 55,000, so that an edit distance of letters is one of words."""
    codes = F.transform(words, lambda word: F.lpad(F.hex(F.pmod(F.xxhash64(word), F.lit(55_000)) + 256), 4, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def _longest(u: str, v: str) -> Column:
    """The characters of the longest word of both."""
    return F.coalesce(F.array_max(F.transform(F.array_union(u, v), F.length)), F.lit(0))


def _similar(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts (id, norm) are similar.

    The words that two lines begin and end with alike don't change their distance; it is computed
    on what lies between. Edits are of characters; if a line is longer than LONG, they are of words."""
    # a side's texts are shuffled at most once, and none that are of no pair
    n = pairs.count()
    named = pairs.select(F.col("b").alias("id")).distinct()
    right = texts.join(F.broadcast(named), "id", "left_semi") if n <= BROADCAST_ROWS else _among(texts, named, F.xxhash64("id"))
    left = texts if n <= BROADCAST_ROWS else _among(texts, pairs.select(F.col("a").alias("id")), F.xxhash64("id"))
    left, right = left.select(F.col("id").alias("a"), F.col("norm").alias("s")), right.select(F.col("id").alias("b"), F.col("norm").alias("t"))
    long = F.greatest(F.length("s"), F.length("t")) > LONG
    words = lambda x: F.split(x, " ")
    size = F.when(long, F.greatest(F.size(words("s")), F.size(words("t")))).otherwise(F.greatest(F.length("s"), F.length("t")))
    like = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    both = small(pairs, n).join(left, "a").join(right, "b").where(F.when(long, like(F.size(words("s")), F.size(words("t")))).otherwise(like(F.length("s"), F.length("t"))))
    both = once(both, "a", "b", long=long, budget=F.floor(size * (100 - percent) / 100).cast("int"), u=words("s"), v=words("t"))

    def alike(u: str, v: str) -> Column:
        """How many words both begin with."""
        first = F.array_position(F.zip_with(u, v, lambda x, y: ~x.eqNullSafe(y)), True)
        return F.when(first > 0, first - 1).otherwise(F.size(u)).cast("int")

    # the rest is turned round, twice
    rest = lambda w: F.reverse(F.slice(w, F.col("p") + 1, F.greatest(F.size(w) - F.col("p"), F.lit(0))))
    for _ in range(2):
        both = once(both, "a", "b", "long", "budget", "u", "v", p=alike("u", "v"))
        both = once(both, "a", "b", "long", "budget", u=rest("u"), v=rest("v"))
    both = once(both, "a", "b", "long", "budget", "u", "v", edits=F.call_function("levenshtein", _letters(F.col("u")), _letters(F.col("v")), F.when(F.col("long"), F.col("budget")).otherwise(2 * F.col("budget"))), most=_longest("u", "v"))
    # an edit of a character turns two words at most, and a word turned costs so many characters at most
    near = F.when(F.col("edits") < 0, F.lit(False)).when(F.col("edits") * F.when(F.col("long"), 1).otherwise(F.col("most") + 1) <= F.col("budget"), True)
    near = near.when(F.col("long"), False).otherwise(F.call_function("levenshtein", F.array_join("u", " "), F.array_join("v", " "), F.col("budget")) >= 0)
    return both.where(near).select("a", "b")


def duplicates(docs: DataFrame, percent: int = PERCENT, short: bool = False) -> DataFrame:
    """doc_id, mark, gone: the line numbers of each document that lose to an earlier occurrence.
    With short, exact copies of lines of fewer than LEAST_WORDS words lose too."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.table(lines_of(docs, short))
    place = F.struct("doc_id", "mark", "line_no")
    cls = lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"), *[F.max(f"w{i}").alias(f"w{i}") for i in range(BLOCKS)])
    cls = scratch.table(cls.withColumn("id", F.monotonically_increasing_id()))
    comp = links(lines, cls, scratch, percent)[1]
    first = cls.select("id", "k1", "k2", "first", "c")
    # most classes are in no group; they take no part in the join by component
    grouped = scratch.table(first.join(small(comp, comp.count()), "id"))
    group = grouped.groupBy("component").agg(F.min("first").alias("best"))
    joined = grouped.join(group, "component").where("c > 1 or best <> first").select("k1", "k2", "best")
    alone = first.where("c > 1").join(small(grouped.select("id"), grouped.count()), "id", "left_anti").select("k1", "k2", F.col("first").alias("best"))
    best = scratch.table(joined.union(alone))
    rows = lines.select("k1", "k2", "doc_id", "mark", "line_no")
    rows = rows if (n := best.count()) <= BROADCAST_ROWS else _among(rows, best)
    lost = rows.join(small(best, n), ["k1", "k2"]).where(place != F.col("best"))
    gone = scratch.table(lost.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("gone")))  # a document's own lines
    scratch.drop(lines, cls, comp, grouped, best)
    return gone


def dedup(docs: DataFrame, percent: int = PERCENT, short: bool = False, n_lines: str = "n_lines", n_gone: str = "n_gone") -> DataFrame:
    """docs with the columns n_lines and n_gone (named as told, in place of columns of those names),
    and text without the lines that are copies.

    A null text stays null. Lines of fewer than LEAST_WORDS words stay unless short is set, which
    takes their exact copies; those without letter and digit always stay. A document whose lines are
    all gone has an empty text. Repeated rows (doc_id and text alike) lose the same lines. Rows
    with null doc_id come first in the order of occurrences. An empty table gives no row.
    """
    gone = duplicates(docs, percent, short)
    size = gone.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("gone")).alias("numbers")).first()
    own, key, mark, lost = (fresh(docs, x) for x in ("own", "key", "mark", "lost"))
    hint = small(gone.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("gone").alias(lost)), size.rows, 48 * size.rows + 4 * (size.numbers or 0))
    text = F.col("text").cast("string")
    marked = docs.drop(n_lines, n_gone).withColumn(own, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = marked.join(hint, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark)), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(lost, i)), "\n")
    counted = joined.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0))).withColumn(n_gone, F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)))
    return counted.withColumn("text", F.when(F.col(lost).isNull(), text).otherwise(kept)).drop(own, key, mark, lost)


def strip(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with their columns, copied lines cut and n_chars, where there is one, counted anew;
    documents of which nothing but white space is left are gone. Other columns stay as they are,
    whatever their names. Nulls, repeated rows and empty tables as in dedup()."""
    lines, gone = fresh(docs, "lines"), fresh(docs, "gone")
    d = dedup(docs, percent, True, lines, gone)
    d = d.where(~((F.col(gone) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*[f"`{c}`" for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_gone of every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), short=True).select("doc_id", "text", "n_lines", "n_gone")
