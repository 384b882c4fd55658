"""Strategies that turn sections into chunks, as array expressions and windows over (document, position)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .groups import per_group


def sections(c: Column, delimiter: str = "\n") -> Column:
    """Sections of a text without blank ones."""
    return F.filter(F.split(c, delimiter), lambda x: F.trim(x) != "")


def delimiter_sections(c: Column, delimiter: str = "\n!?;。；！？") -> Column:
    """Sections between delimiters: single characters, and groups in back-ticks; delimiters are dropped."""
    import re

    groups = [g for g in re.findall(r"`([^`]+)`", delimiter)]
    single = re.sub(r"`[^`]*`", "", delimiter)
    literal = lambda t: "".join({"\n": "\\n", "\t": "\\t", "\r": "\\r", "&": "\\&"}.get(x, re.escape(x)) for x in t)
    alternatives = [literal(g) for g in groups] + ["[" + literal(single) + "]"] * bool(single)
    return F.filter(F.split(c, "|".join(alternatives)), lambda x: F.trim(x) != "") if alternatives else F.array(c)


def greedy_breaks(counts: Column, budget: int) -> Column:
    """Chunk numbers of sections: a chunk is closed only after its count exceeds the budget.

    Numbers instead of texts are folded, so that a long document costs no copies of its text."""
    start = F.struct(F.array().cast("array<int>").alias("no"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("n"))

    def step(acc, n):
        closed = acc["n"] > budget
        chunk = F.when(closed, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(F.concat(acc["no"], F.array(chunk)).alias("no"), chunk.alias("chunk"), F.when(closed, n).otherwise(acc["n"] + n).alias("n"))

    return F.aggregate(counts.cast("array<bigint>"), start, step, lambda acc: acc["no"])


def greedy_merge(df: DataFrame, sections_col: str, budget: int = 128, joiner: str = "\n") -> DataFrame:
    """One row per chunk: the other columns, ``chunk_index`` from 0, ``content`` and ``tokens``."""
    keep = [c for c in df.columns if c != sections_col]
    s = F.col(sections_col)
    df = df.withColumn("_n", F.transform(s, T.token_count)).withColumn("_no", greedy_breaks(F.col("_n"), budget))
    zipped = F.arrays_zip(s.alias("s"), F.col("_n").alias("n"), F.col("_no").alias("no"))
    chunks = F.transform(F.array_distinct("_no"), lambda k: F.filter(zipped, lambda x: x["no"] == k))
    out = df.select(*keep, F.posexplode(chunks).alias("chunk_index", "_c"))
    total = F.aggregate(F.transform("_c", lambda x: x["n"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*keep, F.col("chunk_index"), F.array_join(F.transform("_c", lambda x: x["s"]), joiner).alias("content"), total.alias("tokens"))


def bucketed_rows(df: DataFrame, group: list[str], order: str, text: str, size: int = 10, joiner: str = "; ") -> DataFrame:
    """Rows of a table in chunks of ``size``, joined."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    df = df.withColumn("chunk_index", F.floor(at / size))
    both = df.groupBy(*group, "chunk_index").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("r"))
    return both.select(*group, "chunk_index", F.array_join(F.transform("r", lambda x: x[text]), joiner).alias("content"))


def lines_with_levels(df: DataFrame, id_col: str, text_col: str, strict: bool = True) -> DataFrame:
    """One row per line that isn't blank: id, ``i``, ``line``, the text's bullet ``family`` and the line's ``level``
    (one more than the family has levels for lines without a bullet). ``strict``: numbers that only look like bullets are none."""
    lines = sections(F.col(text_col))
    df = df.select(id_col, lines.alias("_l")).withColumn("family", T.bullet_family(F.col("_l")))
    rows = df.select(id_col, "family", F.posexplode("_l").alias("i", "line"))
    level = F.lit(None).cast("int")
    for k, patterns in enumerate(T.BULLETS):
        own = F.when(F.col("family") == k, F.coalesce(T.bullet_level(F.trim("line"), k, strict), F.lit(len(patterns) + 1)))
        level = F.coalesce(own, level)
    return rows.withColumn("level", F.coalesce(level, F.lit(6)).cast("int"))


def most_frequent_level(lines: DataFrame, id_col: str) -> DataFrame:
    """``most_level``: the most frequent level that is a bullet's, the first to appear of several."""
    counts = lines.where(F.col("family") >= 0).groupBy(id_col, "family", "level").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    sizes = F.array(*[F.lit(len(p)) for p in T.BULLETS])
    counts = counts.where(F.col("level") <= F.element_at(sizes, (F.col("family") + 1).cast("int")))
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "first")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(id_col, F.col("level").alias("most_level"))


def section_islands(lines: DataFrame, most: DataFrame, id_col: str) -> DataFrame:
    """``sid``: a new section begins at a line of the most frequent level or above whose level differs from the line before."""
    w = Window.partitionBy(id_col).orderBy("i")
    new = (F.col("level") <= F.col("most_level")) & (F.col("level") != F.lag("level").over(w))
    return lines.join(most, id_col).withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("sid", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def section_chunks(islands: DataFrame, id_col: str) -> DataFrame:
    """Lines of a section joined."""
    both = islands.groupBy(id_col, "sid").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r"))
    return both.select(id_col, "sid", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("content"))


def packed_sections(tokens_sids: Column) -> Column:
    """Chunk numbers of (tokens, section id) pairs: joined while a chunk is under 32 tokens, or under 1024 and of the section that it
    began with (-1 belongs to any)."""
    start = F.struct(F.array().cast("array<int>").alias("no"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("n"), F.lit(-2).cast("long").alias("sid"))

    def step(acc, x):
        join = (acc["chunk"] >= 0) & ((acc["n"] < 32) | ((acc["n"] < 1024) & ((acc["sid"] == x["sid"]) | (x["sid"] == -1))))
        chunk = F.when(join, acc["chunk"]).otherwise(acc["chunk"] + 1)
        sid = F.when(join | (x["sid"] < 0), acc["sid"]).otherwise(x["sid"].cast("long"))
        return F.struct(F.concat(acc["no"], F.array(chunk)).alias("no"), chunk.alias("chunk"), F.when(join, acc["n"] + x["n"]).otherwise(x["n"]).cast("long").alias("n"), sid.alias("sid"))

    return F.aggregate(tokens_sids, start, step, lambda acc: acc["no"])


def packed_chunks(islands: DataFrame, id_col: str) -> DataFrame:
    """``id_col``, ``chunk_index`` and ``content``: the lines of ``section_islands`` packed as ``packed_sections`` says."""
    rows = islands.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "line", F.col("sid").cast("long").alias("sid"), T.token_count(F.col("line")).alias("n")))).alias("r"))
    rows = rows.withColumn("no", packed_sections(F.transform("r", lambda x: F.struct(x["n"].alias("n"), x["sid"].alias("sid")))))
    each = rows.select(id_col, F.explode(F.arrays_zip(F.col("no").alias("no"), F.col("r").alias("r"))).alias("x")).select(id_col, F.col("x.no").alias("chunk_index"), "x.r.i", "x.r.line")
    both = each.groupBy(id_col, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r"))
    return both.select(id_col, "chunk_index", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("content"))


def with_abstract(sections_df: DataFrame, id_col: str) -> DataFrame:
    """``no`` from 0: the sections (``sid``, ``content``) of a paper, the abstract, from its heading on, as a chunk of its own before them."""
    text = F.col("content")
    at = F.regexp_extract(text, r"(?is)(?:^|\n)[ \t]*((?:abstract|摘要).*)", 1)
    rest = F.when(at == "", text).otherwise(F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(at)), F.lit("\n")))
    first = F.min(F.when(at != "", F.col("sid"))).over(Window.partitionBy(id_col))
    own = sections_df.withColumn("_first", first).withColumn("_a", F.when(F.col("sid") == F.col("_first"), at))
    parts = F.array(F.struct(F.lit(0).alias("kind"), F.col("_a").alias("content")), F.struct(F.lit(1).alias("kind"), F.when(F.col("_a").isNotNull(), rest).otherwise(text).alias("content")))
    each = own.select(id_col, "sid", F.explode(parts).alias("p")).where("p.content is not null and p.content <> ''")
    no = F.row_number().over(Window.partitionBy(id_col).orderBy("p.kind", "sid")) - 1
    return each.select(id_col, no.alias("no"), "p.content")


def greedy_merge_images(df: DataFrame, sections_col: str, budget: int = 128) -> DataFrame:
    """Like ``greedy_merge`` for sections with images (an array of ``text``, ``image``), joined without a separator: ``images`` has
    those of a chunk, from the top."""
    keep = [c for c in df.columns if c != sections_col]
    s = F.col(sections_col)
    df = df.withColumn("_no", greedy_breaks(F.transform(s, lambda x: T.token_count(x["text"])), budget))
    zipped = F.arrays_zip(s.alias("s"), F.col("_no").alias("no"))
    chunks = F.transform(F.array_distinct("_no"), lambda k: F.filter(zipped, lambda x: x["no"] == k))
    out = df.select(*keep, F.posexplode(chunks).alias("chunk_index", "_c"))
    return out.select(*keep, "chunk_index", F.array_join(F.transform("_c", lambda x: x["s"]["text"]), "").alias("content"), F.array_compact(F.transform("_c", lambda x: x["s"]["image"])).alias("images"))


def chunk_fields(chunks: DataFrame, text: str = "content_with_weight") -> DataFrame:
    """Chunks that aren't blank, without position tags, with ``content_ltks`` and ``content_sm_ltks`` (tokens joined by spaces) and
    ``page_num_int``, ``top_int`` and ``position_int``: of the tags, pages from 1; without tags the chunk's number for all of them."""
    from .layout import position_tags, strip_position_tags

    c = F.col(text)
    no = F.col("chunk_index").cast("int")
    tags = F.transform(position_tags(c), lambda p: F.array(p["page"] + 1, *[p[n].cast("int") for n in ("left", "right", "top", "bottom")]))
    own = F.when(F.size(tags) > 0, tags).otherwise(F.array(F.array(no + 1, no, no, no, no)))
    plain = strip_position_tags(c)
    words = F.array_join(T.tokens(T.half_width(plain)), " ")
    out = chunks.where(F.trim(c) != "").withColumn("position_int", own).withColumn(text, plain).withColumn("content_ltks", words).withColumn("content_sm_ltks", words)
    return out.withColumn("page_num_int", F.transform("position_int", lambda p: p[0])).withColumn("top_int", F.transform("position_int", lambda p: p[3]))


def question_family(lines: Column) -> Column:
    """The first family of question numbers that any line begins with, -1 for none (families count once, so the first wins)."""
    begins = lambda p: lambda x: x.rlike(f"^(?:{p})") & ~x.rlike(T.NO_BULLET)
    out = F.lit(-1)
    for i, p in reversed(list(enumerate(T.QUESTIONS))):
        out = F.when(F.exists(lines, begins(p)), i).otherwise(out)
    return F.when(lines.isNotNull(), out)


def heading_paths(lines: DataFrame, id_col: str) -> DataFrame:
    """``path``: the open headings of each line of Markdown; a heading closes those of its level and below."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    df = lines.withColumn("_h", level)
    w = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    slots = []
    for k in range(1, 7):
        last = F.last(F.when(F.col("_h") == k, F.struct("i", F.regexp_replace("line", r"^#+\s*", "").alias("t"))), True).over(w)
        higher = F.max(F.when((F.col("_h") > 0) & (F.col("_h") < k), F.col("i"))).over(w)
        slots.append(F.when(last["i"] > F.coalesce(higher, F.lit(-1)), last["t"]))
    return df.withColumn("path", F.array_compact(F.array(*slots))).drop("_h")


def question_answers(c: Column) -> Column:
    """(question, answer) of lines with a tab; a line without one goes on with the answer before."""
    start = F.array().cast("array<struct<q:string,a:string>>")

    def step(acc, line):
        parts = F.split(line, "\t", 2)
        pair = F.struct(T.remove_answer_prefix(parts[0]).alias("q"), T.remove_answer_prefix(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("a"))
        last = F.try_element_at(acc, F.lit(-1))
        more = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["q"].alias("q"), F.concat(last["a"], F.lit("\n"), line).alias("a"))))
        return F.when(line.contains("\t"), F.concat(acc, F.array(pair))).when(F.size(acc) > 0, more).otherwise(acc)

    return F.aggregate(sections(c), start, step)


def qa_text(q: Column, a: Column, english: Column) -> Column:
    return F.when(english, F.concat(F.lit("Question: "), q, F.lit("\tAnswer: "), a)).otherwise(F.concat(F.lit("问题："), q, F.lit("\t回答："), a))


def drop_contents(c: Column) -> Column:
    """A text without its tables of contents: each from a heading that names one (spaces within it don't count) to the second line
    that begins as the first entry does, looked for in 128 lines; heading and entry alone where there is no such line."""
    lines = F.transform(sections(c), lambda x: F.trim(x))
    heading = lambda x: F.regexp_replace(x, r"[ \t\x{3000}]+", "").rlike(r"^(?i:contents|目录|目次|tableofcontents|致谢|acknowledge)$")
    begin = lambda x: F.when(x.rlike("[一-鿿]"), F.substring(x, 1, 3)).otherwise(F.array_join(F.slice(F.split(x, r"\s+"), 1, 2), " "))
    # one fold over the lines: what is kept; the entry looked for, the lines since it (they come back if it doesn't return)
    empty = F.array().cast("array<string>")
    state = lambda kept, phase, entry, held: F.struct(kept.alias("kept"), phase.alias("phase"), entry.alias("entry"), held.alias("held"))
    blank, none = F.lit(""), F.lit(0)

    def step(a, x):
        named = heading(x)
        fresh = F.when(named, state(a["kept"], F.lit(1), blank, empty)).otherwise(state(F.concat(a["kept"], F.array(x)), none, blank, empty))
        entry = state(a["kept"], F.lit(2), begin(x), empty)
        found = state(F.concat(a["kept"], F.array(x)), none, blank, empty)
        more = state(a["kept"], F.lit(2), a["entry"], F.concat(a["held"], F.array(x)))
        over = state(F.concat(a["kept"], a["held"], F.array(x)), none, blank, empty)
        looking = F.when(x.startswith(a["entry"]), found).when(F.size(a["held"]) < 127, more).otherwise(over)
        return F.when(a["phase"] == 1, entry).when(a["phase"] == 2, looking).otherwise(fresh)

    folded = F.aggregate(lines, state(empty, none, blank, empty), step, lambda a: F.concat(a["kept"], a["held"]))
    return F.array_join(F.when(F.exists(lines, heading), folded).otherwise(lines), "\n")


def colon_titles(c: Column) -> Column:
    """Lines; before a line that ends with a colon its last sentence, if of 32 characters or more, as a title."""
    last = lambda x: F.trim(F.regexp_extract(x, r"([^。？！!?;；]*[:：])$", 1))
    pair = lambda x: F.when(x.rlike("[:：]$") & (F.length(last(x)) >= 32) & (F.length(last(x)) < F.length(x)), F.array(last(x), x)).otherwise(F.array(x))
    return F.flatten(F.transform(sections(c), lambda x: pair(F.trim(x))))


def hierarchical_merge(lines: DataFrame, id_col: str, depth: int = 5, budget: int = 218) -> DataFrame:
    """Chunks of lines with their nearest heading of each higher level before them; single lines are packed under ``budget`` tokens.

    ``lines`` come from ``lines_with_levels`` (not strict). Chunks begin at lines of the ``depth`` lowest levels of the family, whether
    or not the text has lines of each: plain lines, titles without a bullet, then bullets from the lowest up. A heading that
    stands before another chunk begins none of its own; one of the second level stands alone. Where a higher heading comes after
    the lower one taken before it, it takes that one's place.

    What a line needs is told by windows; only the packing goes through Python, a document at a time, as its text is one value anyway."""
    some = lines.where((F.col("family") >= 0) & (F.length(F.trim("line")) > 1) & ~F.trim("line").rlike("^[0-9]+$"))
    size = F.element_at(F.array(*[F.lit(len(p)) for p in T.BULLETS]), F.col("family").cast("int") + 1)
    before = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(max(map(len, T.BULLETS)))
    # from the lowest level up: the last heading of each level before the line
    heads = F.array(*[F.max(F.when(F.col("level") == k, F.col("i"))).over(before) for k in reversed(levels)])
    numbers = F.array(*[F.lit(k) for k in reversed(levels)])
    above = F.transform(F.filter(F.arrays_zip(heads.alias("at"), numbers.alias("level")), lambda h: (h["level"] < F.col("level")) & h["at"].isNotNull()), lambda h: h["at"])
    path = F.aggregate(above, F.array(F.col("i")), lambda acc, h: F.concat(F.when(h > F.element_at(acc, -1), F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc), F.array(h)))
    rank = size + 1 - F.col("level")
    some = some.withColumn("_rank", rank).withColumn("_path", F.when(F.col("level") == 1, F.array("i")).otherwise(path)).withColumn("_size", T.token_count(F.col("line")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, texts = pdf[id_col].iloc[0], dict(zip(pdf["i"], pdf["line"], strict=True))
        taken: set[int] = set()
        out: list[list[int]] = [[]]
        room = budget
        for at, path, rank, n in sorted(zip(pdf["i"], pdf["_path"], pdf["_rank"], pdf["_size"], strict=True), key=lambda r: (r[2], r[0])):
            if rank >= depth or at in taken:
                continue
            taken.update(path)
            if len(path) == 1 and n < room:
                out[-1].append(at)
                room -= n
            else:
                out.append(list(reversed(path)))
                room = budget - n if len(path) == 1 else 0
        rows = ["\n".join(texts[k] for k in x) for x in out if x]
        return pd.DataFrame({id_col: [name] * len(rows), "chunk_index": range(len(rows)), "content": rows})

    kind = lines.schema[id_col].dataType.simpleString()
    return per_group(some.select(id_col, "i", "line", "_path", "_rank", "_size"), [id_col], run, f"`{id_col}` {kind}, chunk_index int, content string")


def outline_levels(sections_df: DataFrame, outlines: DataFrame, id_col: str, threshold: float = 0.8) -> DataFrame:
    """The level of the first outline entry whose pairs of characters are like a section's; null if none is.

    Candidates share a document and a pair of characters, so no section meets all entries of other documents."""
    s = sections_df.select(id_col, "i", "line", F.explode(T.bigrams(F.col("line"))).alias("g"))
    o = outlines.select(id_col, "outline_no", "title", "outline_level", F.explode(T.bigrams(F.col("title"))).alias("g"))
    pairs = s.join(o, [id_col, "g"]).select(id_col, "i", "line", "outline_no", "title", "outline_level").distinct()
    hit = pairs.where(T.bigram_similarity(F.col("line"), F.col("title")) > threshold).groupBy(id_col, "i").agg(F.min_by("outline_level", "outline_no").alias("outline_level"))
    return sections_df.join(hit, [id_col, "i"], "left")


def one_chunk(df: DataFrame, text_col: str) -> DataFrame:
    """The whole text as one chunk."""
    return df.withColumn("chunk_index", F.lit(0)).withColumn("content", F.array_join(sections(F.col(text_col)), "\n"))


def _json_nodes(text: str) -> list[tuple[tuple[str, ...], int, int, object]]:
    """The nodes of a JSON value in the order of the text: path, length of the value as JSON, number of the next node that isn't
    below it, and the value of a leaf. Lists count as objects with their indices as keys; an empty list or object is a leaf."""
    import json

    nodes: list = []
    waiting: list[tuple[tuple[str, ...], object]] = [((), json.loads(text))]
    while waiting:
        path, value = waiting.pop()
        inner = [(str(i), x) for i, x in enumerate(value)] if isinstance(value, list) else list(value.items()) if isinstance(value, dict) else []
        nodes.append([path, 0, 0, None if inner else {} if isinstance(value, list) else value, [len(json.dumps(k, ensure_ascii=False)) for k, _ in inner]])
        waiting += [((*path, k), x) for k, x in reversed(inner)]
    # lengths and ends come from behind: the children of a node follow it
    ends: list[int] = []
    for i in reversed(range(len(nodes))):
        keys, node = nodes[i][4], nodes[i]
        if keys:
            children = [ends.pop() for _ in keys]
            node[1] = 2 + sum(k + 2 + nodes[c][1] for k, c in zip(keys, children, strict=True)) + 2 * (len(keys) - 1)
            node[2] = nodes[children[-1]][2]
        else:
            node[1], node[2] = len(json.dumps(node[3], ensure_ascii=False)), i + 1
        ends.append(i)
    return [(tuple(n[0]), n[1], n[2], n[3]) for n in nodes]


def json_portions(text: str, most: int, least: int) -> list[str]:
    """Objects of under ``most`` characters each with the leaves of a JSON value, in order and with their paths.

    A node goes into the open object as a whole if it fits; else the object is closed if it has ``least`` characters, and the
    node's children are tried one by one. A single leaf that is too long is kept whole. A value that is no object or list is one
    leaf, named ``value``."""
    import json

    nodes = _json_nodes(text)
    if len(nodes) == 1:
        return [] if nodes[0][3] == {} else [json.dumps({"value": nodes[0][3]}, ensure_ascii=False)]
    key = lambda k: len(json.dumps(k, ensure_ascii=False)) + 2
    portions: list[list[int]] = [[]]
    size, last = 2, ()
    i = 1
    while i < len(nodes):
        path, length, end, _ = nodes[i]
        leaf = end == i + 1
        # the key and the value as an object of their own: what must fit into the rest
        fits = 2 + key(path[-1]) + length < most - size
        if not fits and size >= least:
            portions.append([])
            size, last = 2, ()
        if fits or leaf:
            if portions[-1]:
                shared = next((k for k, (x, y) in enumerate(zip(path, last, strict=False)) if x != y), min(len(path), len(last)))
                size += 2  # a comma beside what the shared parent has
            else:
                shared = 0
            size += length + sum(map(key, path[shared:])) + 2 * (len(path) - shared - 1)
            portions[-1] += [j for j in range(i, end) if nodes[j][2] == j + 1]
            last = nodes[end - 1][0]
            i = end
        else:
            i += 1
    out = []
    for leaves in portions:
        value: dict = {}
        for j in leaves:
            target = value
            for k in nodes[j][0][:-1]:
                target = target.setdefault(k, {})
            target[nodes[j][0][-1]] = nodes[j][3]
        if value:
            out.append(json.dumps(value, ensure_ascii=False))
    return out


def split_json(df: DataFrame, id_col: str, json_col: str, most: int = 2000, least: int | None = None) -> DataFrame:
    """``id_col``, ``chunk_index`` and ``content``: the portions of each JSON value. Values that aren't JSON give no row."""
    low = least if least is not None else max(most - 200, 50)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["_id"], pdf["_j"], strict=True):
                try:
                    rows += [(i, k, x) for k, x in enumerate(json_portions(text, most, low))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "content"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(json_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(json_col).alias("_j")).mapInPandas(run, f"`{id_col}` {kind}, chunk_index int, content string")
