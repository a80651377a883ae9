"""Column-level data quality profile (problem 2).

Method: every distinct value is generalised on four levels, from runs of exact length to the mere set of character
classes. The levels form a tree; from the bottom up, a node becomes an expression when stating it and the values given it costs fewer bits than the
expressions below it (minimum description length). Values whose best expression costs more than the plain text conform to none.
The shares of rows that each expression covers are compared between loads, next to nulls, blanks, frequent values, lengths and ranges.

All steps are aggregations by column and value or expression; what reaches the driver is the list of load numbers.

Defined cases: null, and blank for texts, are counted apart and have no expression; an empty table gives an empty profile; nested fields are named by
their path, arrays and maps are profiled as JSON; fewer than four loads can't be compared and give no finding; repeated rows count as rows; columns
may have any name, since cells are kept as (column, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marlstone.session import shared_table

#: A share or a logarithm is far off when it leaves the median of the loads by this many robust spreads and by the least difference.
SPREADS, LEAST_SHARE, LEAST_LOG, FREQUENT = 8.0, 0.1, 0.35, 0.05
MIN_LOADS = 4


def flat_columns(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """(path, text value) of every leaf column."""
    out = []
    for f in schema.fields:
        path, quoted = f"{prefix}{f.name}", ".".join(f"`{p}`" for p in [*prefix.rstrip(".").split("."), f.name] if p)
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, f"{path}.")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append((path, F.to_json(F.col(quoted))))
        elif isinstance(f.dataType, T.BinaryType):
            out.append((path, F.base64(F.col(quoted))))
        else:
            out.append((path, F.col(quoted).cast("string")))
    return out


_rep = F.regexp_replace


def _chars(v: Column) -> Column:
    """Level 0: the class of each character; signs stay. As long as the value."""
    return _rep(_rep(_rep(_rep(v, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"[\p{Lo}\p{Lm}\p{M}]", "x"), r"\p{N}", "9")


def _runs(chars: Column) -> Column:
    """Level 1: runs without their lengths."""
    return _rep(_rep(chars, r"([Aax9])\1+", "$1+"), r"\s+", " ")


def _words(chars: Column) -> Column:
    """Level 2: any run of letters is w; lists of words become one step, and so do sentences of them."""
    words = _rep(_rep(_rep(_rep(chars, "[Aax]+(?:['’-][Aax]+)*", "w"), "9+", "9"), r"\s+", " "), r"(?:[w9][,;:]? ){2,}", "(w )+")
    return _rep(words, r"(?:\(w \)\+[w9][.!?。！？,;:]? ?){2,}", "((w )+w. )+")


def _classes(v: Column) -> Column:
    """Level 3: the set of classes and the closing mark."""
    has = lambda p, s: F.when(v.rlike(p), F.lit(s)).otherwise(F.lit(""))
    return F.concat(F.lit("["), has(r"\p{Lu}", "A"), has(r"\p{Ll}", "a"), has(r"[\p{Lo}\p{Lm}]", "x"), has(r"\p{N}", "9"), has(r"\s", " "), has("<[A-Za-z/]", "<>"), has(r"[\u0080-\u009f\u00bf\ufffd\u20ac\u2122]", "~"), has("^-", "-"), F.lit("]+"), F.regexp_extract(v, r"([.!?。！？…])\s*$", 1))


def level_label(level: Column, value: Column) -> Column:
    """The generalisation of a value on a level, 0 to 3."""
    return F.when(level == 0, _chars(value)).when(level == 1, _runs(_chars(value))).when(level == 2, _words(_chars(value))).when(level == 3, _classes(value))


_LETTER, _UNIT = r"[\p{L}\p{M}]+", r"(?:[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*+|\p{N}+)"
#: What the parts of an induced expression stand for: runs of words, sentences of them, one word.
_WORDS = rf"(?:{_UNIT}[,;:]?\s+){{2,}}+"
_SENTENCES = rf"(?:{_WORDS}{_UNIT}[.!?。！？,;:]?\s*){{2,}}+"


def expression_regex(level: Column, expression: Column) -> Column:
    """The regular expression that an induced expression abbreviates, to be applied to a column with rlike; null for none.

    Levels are those of `induced_expressions`: 0 characters, 1 runs, 2 words, 3 the set of classes. Signs of a value stand for themselves.
    """
    put = lambda c, *pairs: c if not pairs else put(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:])
    quoted = F.regexp_replace(expression, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    chars = (("A", r"\p{Lu}"), ("a", r"\p{Ll}"), ("x", r"[\p{Lo}\p{Lm}\p{M}]"), ("9", r"\p{N}"))
    runs = F.regexp_replace(quoted, r"([Aax9])\\\+", "$1{2,}")
    # marks that no text holds keep what is put in from being taken for more of the expression
    marked = put(quoted, (r"\(\(w \)\+w\. \)\+", "\ue002"), (r"\(w \)\+", "\ue001"), ("w", "\ue003"), ("9", "\ue004"), (" ", r"\s+"))
    words = put(marked, ("\ue002", _SENTENCES), ("\ue001", _WORDS), ("\ue003", rf"{_LETTER}(?:['’-]{_LETTER})*+"), ("\ue004", r"\p{N}+"))
    held = F.regexp_extract(expression, r"^\[(.*)\]\+", 1)
    some = lambda mark, what: F.when(held.contains(mark), F.lit(what)).otherwise("")
    classes = F.concat(F.lit(r"[[^\p{L}\p{N}\s]\p{M}\p{Lt}"), some("A", r"\p{Lu}"), some("a", r"\p{Ll}"), some("x", r"\p{Lo}\p{Lm}"), some("9", r"\p{N}"), some(" ", r"\s"), F.lit("]+"))
    last = F.regexp_extract(expression, r"\]\+(.?)$", 1)
    closed = F.when(last != "", F.concat(F.lit("["), last, F.lit(r"]\s*"))).otherwise("")
    body = F.when(level == 0, put(quoted, *chars)).when(level == 1, put(put(runs, *chars), (" ", r"\s+"))).when(level == 2, words).otherwise(F.concat(classes, closed))
    return F.concat(F.lit(r"(?s)\A"), body, F.lit(r"\z"))


_BITS = (("A", 4.7), ("a", 4.7), ("x", 12.0), ("9", 3.3))


PATH = ["col", "h3", "h2", "h1", "h0"]


def _cells(df: DataFrame, columns: list[tuple[str, Column]], load: Column) -> DataFrame:
    """One row for each distinct value of a column and load: (load, col, value, n, blank), and of values that aren't null or blank the hashes h0 to h3 of
    their levels, vh of the value itself, the lengths of value and levels, and the bits b0 and b3.

    A level is a function of the value, so its hash stands for it from here on; the few texts that are shown are made again (`level_label`).
    """
    cell = F.explode(F.array(*[F.struct(F.lit(n).alias("col"), c.alias("value")) for n, c in columns]))
    counts = df.select(load.cast("string").alias("load"), cell.alias("c")).groupBy("load", F.col("c.col").alias("col"), F.col("c.value").alias("value")).agg(F.count("*").alias("n"))
    # in steps, so that the characters' classes are found once for the levels above them
    one = counts.withColumn("full", F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\s\p{Z}\p{C}]*$"))
    two = one.withColumn("l0", F.when(F.col("full"), _chars(F.col("value")))).withColumn("l3", F.when(F.col("full"), _classes(F.col("value"))))
    all_ = two.withColumn("l1", _runs(F.col("l0"))).withColumn("l2", _words(F.col("l0")))
    l3, size = F.col("l3"), F.length("value")
    b0 = sum(((size - F.length(F.translate("l0", k, ""))) * w for k, w in _BITS), F.lit(0.0))
    # under the set of classes each character may be any of them
    b3 = size * F.log2(2 + 26.0 * l3.contains("A").cast("int") + 26 * l3.contains("a").cast("int") + 4000 * l3.contains("x").cast("int") + 10 * l3.contains("9").cast("int"))
    hashed = [F.when(F.col("full"), F.xxhash64(f"l{i}")).alias(f"h{i}") for i in range(4)]
    return all_.select("load", "col", "value", "n", (F.col("value").isNotNull() & ~F.col("full")).alias("blank"), F.xxhash64("value").alias("vh"), *hashed, size.alias("len"), *[F.length(f"l{i}").alias(f"n{i}") for i in (1, 2, 3)], b0.alias("b0"), b3.alias("b3"))


def induced_expressions(cells: DataFrame) -> DataFrame:
    """(col, h3, h2, h1, h0, level): for each finest form the level of the expression of the cheapest description; null if it is the plain text."""
    # equal values and equal forms lie together after one shuffle
    laid = cells.where("h3 is not null").select(*PATH, "vh", "len", "n1", "n2", "n3", "b0", "b3").repartition("col", "h0")
    values = laid.groupBy(*PATH, "vh").agg(*[F.first(c).alias(c) for c in ("len", "n1", "n2", "n3", "b0", "b3")])
    bits = {
        "b0": F.col("b0"),
        # the upper levels add the run lengths, the word types, and all classes for each character
        "b1": F.col("b0") + F.col("n1") * 1.5,
        "b2": F.col("b0") + F.col("n1") * 3.5,
        "b3": F.col("b3"),
        "raw": F.col("len") * 11.0 + 16,
    }
    leaf = values.groupBy(*PATH).agg(F.first("len").alias("n0"), *[F.first(n).alias(n) for n in ("n1", "n2", "n3")], *[F.sum(c).alias(k) for k, c in bits.items()])
    state = lambda n: 20 + 10.0 * F.col(n)
    leaf = shared_table(leaf.withColumn("cost", state("n0") + F.col("b0")), "expressions")
    levels, below = [], leaf
    for depth in (1, 2, 3):
        keys = PATH[: 5 - depth]
        rest = [f"n{i}" for i in range(depth, 4)] + [f"b{i}" for i in range(depth, 4)] + ["raw"]
        up = below.groupBy(*keys).agg(F.sum("cost").alias("under"), *[(F.first(c) if c[0] == "n" else F.sum(c)).alias(c) for c in rest])
        own = state(f"n{depth}") + F.col(f"b{depth}")
        below = up.withColumn("own", own < F.col("under")).withColumn("cost", F.least(own, F.col("under")))
        # what is decided on this level: nothing, an expression, or that the text is cheaper
        levels.append(below.select(*keys, F.when(F.col("own"), F.when(F.col("cost") < F.col("raw"), F.lit(depth)).otherwise(-1)).alias(f"d{depth}")))
    out = leaf.select(*PATH, F.when(F.col("cost") < F.col("raw"), F.lit(0)).otherwise(-1).alias("d0"))
    for lv in levels:
        out = out.join(lv, [c for c in lv.columns if c in PATH])
    return out.select(*PATH, F.nullif(F.coalesce("d3", "d2", "d1", "d0"), F.lit(-1)).alias("level"))


class Profile:
    """The profile of a table; `columns` defaults to all its leaf columns, `load` to one load."""

    def __init__(self, df: DataFrame, columns: list[tuple[str, Column]] | None = None, load: Column | None = None) -> None:
        self.cells = shared_table(_cells(df, columns or flat_columns(df.schema), F.lit("all") if load is None else load), "cells")
        forms = self.cells.where("h3 is not null").groupBy("load", *PATH).agg(F.sum("n").alias("n"))
        chosen = forms.join(induced_expressions(self.cells), PATH, "left")
        named = F.when(F.col("level") == 0, F.col("h0")).when(F.col("level") == 1, F.col("h1")).when(F.col("level") == 2, F.col("h2")).when(F.col("level") == 3, F.col("h3"))
        #: (load, col, level, h, n): rows of each load under each expression, which is called by its level and hash; null for nonconforming ones.
        self.forms = shared_table(chosen.groupBy("load", "col", "level", named.alias("h")).agg(F.sum("n").alias("n")), "forms")

    def _texts(self, some: DataFrame) -> DataFrame:
        """(col, level, h, expression) of the expressions in `some` (col, level, h), made from the least value of each."""
        wanted = some.select("col", "level", "h").where("level is not null").distinct()
        out = None
        for level in range(4):
            own = self.cells.select("col", F.col(f"h{level}").alias("h"), "value").join(wanted.where(F.col("level") == level), ["col", "h"])
            one = own.groupBy("col", "level", "h").agg(F.min("value").alias("value"))
            out = one if out is None else out.unionByName(one)
        return out.select("col", "level", "h", level_label(F.col("level"), F.col("value")).alias("expression"))

    def columns(self) -> DataFrame:
        """One row a column: rows, nulls, blanks, distinct values, extremes, mean length, expressions and rows that conform to none."""
        num = F.col("value").try_cast("double")
        text = F.col("value").isNotNull()
        stats = self.cells.groupBy("col").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(~text, F.col("n"))), F.lit(0)).alias("n_null"),
            F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("n_blank"),
            F.min("value").alias("min_text"),
            F.max("value").alias("max_text"),
            F.min(num).alias("min_number"),
            F.max(num).alias("max_number"),
            F.round(F.sum(F.col("len") * F.col("n")) / F.sum(F.when(text, F.col("n"))), 6).alias("mean_length"),
        )
        # hashes of 64 bits and the length tell values apart
        distinct = self.cells.where(text).select("col", "vh", "len").distinct().groupBy("col").agg(F.count("*").alias("n_distinct"))
        e = self.forms.groupBy("col").agg(F.count_distinct("level", "h").alias("n_expressions"), F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).alias("n_nonconforming"))
        got = stats.join(distinct, "col", "left").join(e, "col", "left").na.fill(0, ["n_distinct", "n_expressions", "n_nonconforming"])
        return got.select("col", "n_rows", "n_null", "n_blank", "n_distinct", "min_text", "max_text", "min_number", "max_number", "mean_length", "n_expressions", "n_nonconforming")

    def expressions(self) -> DataFrame:
        """(col, expression, regex, load, n): rows of each load that each expression covers, and the regular expression to find them by; a null expression is nonconforming."""
        got = self.forms.join(self._texts(self.forms), ["col", "level", "h"], "left")
        return got.select("col", "expression", expression_regex(F.col("level"), F.col("expression")).alias("regex"), "load", "n")

    def _metrics(self) -> DataFrame:
        """(col, load, metric, x, is_share, n_load)."""
        size = self.cells.groupBy("col", "load").agg(F.sum("n").alias("n_load"))
        tab = self.cells.groupBy("col", "load").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blanks"))
        share = tab.select("col", "load", F.explode(F.create_map(F.lit("null"), "nulls", F.lit("blank"), "blanks")).alias("metric", "m"))
        cover = self.forms.select("col", "load", F.concat_ws(" ", F.lit("form"), F.coalesce(F.col("level").cast("string"), F.lit("none")), F.col("h").cast("string")).alias("metric"), F.col("n").alias("m"))
        value = self.cells.where("h3 is not null").select("col", "load", F.concat(F.lit("value "), "value").alias("metric"), F.col("n").alias("m")).join(size, ["col", "load"]).where(F.col("m") >= F.greatest(F.lit(3), FREQUENT * F.col("n_load"))).drop("n_load")
        kept = cover.join(size, ["col", "load"]).groupBy("col", "metric").agg(F.max(F.col("m") / F.col("n_load")).alias("top")).where(F.col("top") >= FREQUENT).select("col", "metric")
        shares = share.unionByName(cover.join(kept, ["col", "metric"])).unionByName(value).join(size, ["col", "load"]).select("col", "load", "metric", (F.col("m") / F.col("n_load")).alias("x"), F.lit(True).alias("is_share"), "n_load")
        full = self.cells.where("h3 is not null")
        number = F.col("value").try_cast("double")
        # rounded logarithms take few values, so that exact percentiles need little memory however many values there are
        logs = full.withColumn("len", F.round(F.log(F.col("len").cast("double")), 3)).withColumn("num", F.round(F.signum(number) * F.log1p(F.abs(number)), 3))
        q = lambda c, p: F.percentile(c, F.lit(p), F.col("n"))
        per = logs.groupBy("col", "load").agg(*[q(c, p).alias(f"{c}{p}") for c in ("len", "num") for p in (0.1, 0.5, 0.9)])
        pairs = [x for c in ("len", "num") for p in (0.1, 0.5, 0.9) for x in (F.lit(f"{c} {p}"), F.col(f"`{c}{p}`"))]
        quant = per.select("col", "load", F.explode(F.create_map(*pairs)).alias("metric", "x")).where("x is not null").join(size, ["col", "load"]).select("col", "load", "metric", "x", F.lit(False).alias("is_share"), "n_load")
        return shares.unionByName(quant)

    def odd_loads(self, named: bool = True) -> DataFrame:
        """(col, load, metric, x, usual, spreads): the loads that break with the rest, with every measure by which they do.

        Unless `named`, expressions are called by level and hash instead of their text.
        """
        metrics = shared_table(self._metrics(), "metrics")
        loads = sorted(r.load for r in self.cells.select("load").distinct().collect() if r.load is not None)
        none = metrics.select("col", "load", "metric", "x", F.lit(0.0).alias("usual"), F.lit(0.0).alias("spreads")).limit(0)
        if len(loads) < MIN_LOADS:
            return none
        # a load that lacks a form or value has it at share 0
        by = metrics.where("load is not null").groupBy("col", "metric", "is_share").agg(F.map_from_entries(F.collect_list(F.struct("load", F.struct("x", "n_load")))).alias("at"))
        sizes = self.cells.where("load is not null").groupBy("load", "col").agg(F.sum("n").alias("n_load")).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("load", "n_load"))).alias("sizes"))
        rows = by.join(sizes, "col").select("col", "metric", "is_share", "sizes", F.col("at"), F.explode(F.array(*[F.lit(x) for x in loads])).alias("load"))
        x = F.coalesce(F.try_element_at("at", F.col("load"))["x"], F.when(F.col("is_share"), F.lit(0.0)))
        rows = rows.select("col", "metric", "is_share", "load", x.alias("x"), F.try_element_at("sizes", F.col("load")).alias("n_load")).where("x is not null and n_load is not null")
        w = W.partitionBy("col", "metric")
        mid = rows.withColumn("usual", F.percentile("x", F.lit(0.5)).over(w))
        mad = mid.withColumn("mad", 1.4826 * F.percentile(F.abs(F.col("x") - F.col("usual")), F.lit(0.5)).over(w))
        chance = F.when(F.col("is_share"), F.sqrt(F.greatest(F.col("usual") * (1 - F.col("usual")), F.lit(0.0025)) / F.col("n_load")) + 0.005).otherwise(0.03 + 0.5 / F.sqrt(F.col("n_load")))
        spread = F.greatest(F.col("mad"), chance)
        off = F.abs(F.col("x") - F.col("usual"))
        least = F.when(F.col("is_share"), LEAST_SHARE).otherwise(LEAST_LOG)
        odd = mad.where((off > SPREADS * spread) & (off > least)).select("col", "load", "metric", F.round("x", 6).alias("x"), F.round("usual", 6).alias("usual"), F.round(off / spread, 3).alias("spreads"))
        if not named:
            return odd
        odd = shared_table(odd, "odd")
        part = F.split("metric", " ")
        form = F.col("metric").startswith("form ") & (F.col("metric") != "form none")
        called = odd.withColumn("level", F.when(form, part[1].cast("int"))).withColumn("h", F.when(form, part[2].cast("bigint")))
        got = called.join(self._texts(called), ["col", "level", "h"], "left")
        return got.select("col", "load", F.coalesce(F.concat(F.lit("form "), "expression"), "metric").alias("metric"), "x", "usual", "spreads")


def odd_points(df: DataFrame, at: str, value: str, around: int = 5, least: float = 0.1, spreads: float = 10.0) -> DataFrame:
    """(at, value, usual): points of a series, one a day or so, whose value can't fit the `around` points on either side.

    Usual is the median of the neighbours; a point is odd when its logarithm leaves it by `least` and by `spreads` times the
    neighbours' median deviation, or when its sign differs. Null points and values are left out, repeated rows count once.
    """
    days = df.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(at).alias("at"), F.col(value).alias("v")).agg(F.lit("series").alias("s"))
    w = W.partitionBy("s").orderBy("at", "v")
    near = days.withColumn("before", F.collect_list("v").over(w.rowsBetween(-around, -1))).withColumn("after", F.collect_list("v").over(w.rowsBetween(1, around)))
    near = near.withColumn("all", F.array_sort(F.concat("before", "after"))).where(F.size("all") >= 3)
    middle = lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int")).cast("double")
    near = near.withColumn("usual", middle(F.col("all")))
    log = lambda c: F.log(F.greatest(c.cast("double"), F.lit(1e-9)))
    near = near.withColumn("dev", middle(F.array_sort(F.transform("all", lambda x: F.abs(log(x) - log(F.col("usual")))))))
    off = F.abs(log(F.col("v")) - log(F.col("usual")))
    odd = (F.col("usual") > 0) & ((F.col("v") <= 0) | (off > F.greatest(F.lit(least), spreads * F.col("dev"))))
    return near.where(odd).select(F.col("at").alias(at), F.col("v").alias(value), F.col("usual"))
