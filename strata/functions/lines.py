"""Comment and blank-line filter as a fold over a file's lines; no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each family: how whole-line comments start, and the (opening, closing) marks of block comments.
LINE_MARKS = {"c": r"^(//|\*$|\* |\*/)", "hash": "^#", "python": "^#", "ruby": "^#", "sql": "^--", "lua": "^--", "haskell": "^--"}
BLOCKS = {
    "c": [("/*", "*/")],
    "sql": [("/*", "*/")],
    "python": [('"""', '"""'), ("'''", "'''")],
    "ruby": [("=begin", "=end")],
    "html": [("<!--", "-->")],
    "lua": [("--[[", "]]")],
    "haskell": [("{-", "-}")],
}
FAMILIES = ("c", "hash", "python", "ruby", "html", "sql", "lua", "haskell")


def _quote(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+?^$|" else ch for ch in text)


def _peeled(line: Column, family: str) -> Column:
    """The line without the block comments that open and close at its start."""
    if family == "ruby":  # an opening there always goes on to a later line
        return line
    marks = "|".join(f"{_quote(a)}.*?{_quote(z)}" for a, z in BLOCKS.get(family, []))
    return F.regexp_replace(line, rf"^(?:(?:{marks})\s*)+", "") if marks else line


def _transition(end: Column, raw: Column, family: str) -> tuple[Column, Column]:
    """From the mark that closes the open block ("" outside of one) and a line the next such mark, and whether the line
    is blank or only comment."""
    line = F.regexp_replace(raw, r"^\s+|\s+$", "")
    closed = F.position(end, line)
    inside = (end != "") & (closed == 0)
    after = F.when(end == "", line).otherwise(F.ltrim(F.substr(line, closed + F.length(end))))
    rest = _peeled(after, family)
    comment = rest.rlike(LINE_MARKS[family]) if family in LINE_MARKS else F.lit(False)
    # In C style and SQL the line marks of a line go before its blocks; what peels off never starts with one.
    opens = F.lit("")
    for a, z in BLOCKS.get(family, []):
        opens = F.when(rest.startswith(a), F.lit(z)).otherwise(opens)
    if family != "lua":
        opens = F.when(comment, F.lit("")).otherwise(opens)
    skip = (line == "") | inside | (rest == "") | comment | (opens != "")
    next_end = F.when(line == "", end).when(inside, end).otherwise(opens)
    return next_end, skip


def _step(state: Column, raw: Column, family: str) -> Column:
    """(end, flags) and a line -> the next state."""
    end, skip = _transition(state["end"], raw, family)
    return F.struct(end.alias("end"), F.concat(state["flags"], F.array(skip)).alias("flags"))


#: Lines that a fold appends to one array; a longer file is an array of such arrays, as each append copies the array.
PART = 256


def _fold(lines: Column, family: str) -> Column:
    none = F.array().cast("array<boolean>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / PART).cast("int")), lambda i: F.slice(lines, i * PART + 1, F.lit(PART)))

    def step(state: Column, part: Column) -> Column:
        start = F.struct(state["end"].alias("end"), none.alias("flags"))
        done = F.aggregate(part, start, lambda s, x: _step(s, x, family))
        both = lambda r: F.struct(r["end"].alias("end"), F.concat(state["parts"], F.array(r["flags"])).alias("parts"))
        return F.transform(F.array(done), both)[0]

    start = F.struct(F.lit("").alias("end"), F.array().cast("array<array<boolean>>").alias("parts"))
    return F.when(F.size(lines) > 0, F.aggregate(parts, start, step, lambda s: F.flatten(s["parts"]))).otherwise(none)


def skip_flags(lang: Column, lines: Column) -> Column:
    """For each line whether it is blank or only comment; prose and unknown families skip nothing."""
    out = F.transform(lines, lambda _: F.lit(False))
    for family in FAMILIES:
        out = F.when(lang == family, _fold(lines, family)).otherwise(out)
    return out


def count_code_lines(lang: Column, lines: Column) -> Column:
    """How many lines skip_flags() leaves: the state is a mark and a number, so no array grows with the lines."""

    def counted(family: str) -> Column:
        def step(state: Column, raw: Column) -> Column:
            end, skip = _transition(state["end"], raw, family)
            return F.struct(end.alias("end"), (state["n"] + F.when(skip, 0).otherwise(1)).alias("n"))

        return F.aggregate(lines, F.struct(F.lit("").alias("end"), F.lit(0).alias("n")), step, lambda s: s["n"])

    out = F.size(lines)
    for family in FAMILIES:
        out = F.when(lang == family, counted(family)).otherwise(out)
    return out


# --- lines as rows ---------------------------------------------------------------------------------------------------

#: The states that a line can begin in, by family: outside of a block, or in one that a mark closes.
STATES = {f: ["", *dict.fromkeys(z for _, z in BLOCKS.get(f, []))] for f in FAMILIES}


def skipped_rows(rows: DataFrame, by: tuple[str, ...] = ("path",), at: str = "line_no", chunk: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """rows(*by, line_no, lang, line, *carry) -> with `skipped`, as skip_flags() has it, for files of any length.

    A run of lines is a function from the state it begins in to the state it ends in. Each chunk of a file is folded
    into that table (one entry a state) where its lines are, the tables of a file's chunks are composed in order, and
    each chunk then starts from its own state: no task or array takes in a file, only its chunks' tables."""
    rows = rows.withColumn("_chunk", F.floor(F.col(at) / chunk))
    key = [*by, "_chunk"]
    chunks = rows.groupBy(*key).agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct(at, "line", *carry))).alias("_lines"))
    text = F.transform("_lines", lambda x: F.coalesce(x["line"], F.lit("")))

    def table(family: str) -> Column:
        run = lambda s: F.aggregate(text, F.lit(s), lambda end, raw: _transition(end, raw, family)[0])
        return F.array(*(F.struct(F.lit(s).alias("from"), run(s).alias("to")) for s in STATES[family]))

    tables = F.array(F.struct(F.lit("").alias("from"), F.lit("").alias("to")))
    for family in FAMILIES:
        tables = F.when(F.col("lang") == family, table(family)).otherwise(tables)
    tables = chunks.select(*key, tables.alias("t"))
    course = tables.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_chunk", "t"))).alias("all"))  # a table a chunk
    look = lambda t, s: F.coalesce(F.filter(t, lambda e: e["from"] == s)[0]["to"], F.lit(""))
    starts = course.select(*by, F.posexplode("all").alias("i", "c"), "all").select(
        *by, F.col("c._chunk").alias("_chunk"), F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(""), lambda s, c: look(c["t"], s)).alias("_start")
    )
    begun = chunks.join(starts, key)

    def flags(family: str) -> Column:
        start = F.struct(F.col("_start").alias("end"), F.array().cast("array<boolean>").alias("flags"))
        return F.aggregate(text, start, lambda s, x: _step(s, x, family), lambda s: s["flags"])

    out = F.transform("_lines", lambda _: F.lit(False))
    for family in FAMILIES:
        out = F.when(F.col("lang") == family, flags(family)).otherwise(out)
    zipped = F.arrays_zip(F.col("_lines").alias("l"), out.alias("skipped"))
    done = begun.select(*by, "lang", F.explode(zipped).alias("z"))
    return done.select(*by, f"z.l.{at}", "lang", "z.l.line", "z.skipped", *(f"z.l.{c}" for c in carry))


def code_lines(lang: Column, lines: Column) -> Column:
    """The lines that stay, as an array."""
    kept = F.arrays_zip(lines.alias("line"), skip_flags(lang, lines).alias("skipped"))
    return F.transform(F.filter(kept, lambda x: ~x["skipped"]), lambda x: x["line"])
