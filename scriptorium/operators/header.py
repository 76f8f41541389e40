"""Header metadata of a text, from the lines before its first heading.

Every line is classified by itself, running flags over the lines tell what it means where it stands, and ordered
aggregates give the result: no line is walked over in Python, and all windows share one shuffle by the text's id.

The lines fall into blocks between blank ones. An introduction is what follows its label to the end of the block; the
first label of a text, if nothing follows in its block, takes the next block whole. Of what is left, labels give title
and author, on their own line or, after a bare label, on the next line that begins with a colon; a line in 《》 is a
title as long as there is none; the other lines are candidates, of which the first and second may be title and author.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..rules import Rules
from . import lines as N

#: The labels of a header, and how many lines may be candidates.
_LABEL = r"(?Us)^(书名|作者|作\s*者|内容简介|简介|内容介绍|文案)\s*[:：](.*)$"
TITLE, AUTHOR, INTRO = ("书名",), ("作者", "作 者"), ("内容简介", "简介", "内容介绍", "文案")
BARE_TITLE = ("书名", "书 名")
CANDIDATES = 6


def _classified(rows: DataFrame) -> DataFrame:
    """what: title, author or intro where the line is a label's; value: what stands behind it, '' for nothing."""
    s = F.col("bare")
    label = F.regexp_extract(s, _LABEL, 1)
    by_label = F.when(label.isin(*TITLE), "title").when(label.isin(*AUTHOR), "author").otherwise("intro")
    alone = F.when(s.isin(*BARE_TITLE), "title").when(s.isin(*AUTHOR), "author").when(s.isin(*INTRO), "intro")
    return rows.withColumns({"what": F.when(label != "", by_label).otherwise(alone), "value": F.when(label != "", X.strip(F.regexp_extract(s, _LABEL, 2))).otherwise("")})


def _prelude(docs: DataFrame, key: str, text: str, name: Column, rules: Rules) -> DataFrame:
    """The lines before the first heading; a text without such lines keeps one row. The last one counts as beside a blank."""
    rows = docs.select(key, name.alias("_name"), F.posexplode_outer(N.split_file(text)).alias("line_no", "line"))
    rows = N.with_context(rows, key).withColumn("kind", N.heading_kind(rules))
    stop = F.coalesce(F.min(F.when(F.col("kind").isNotNull(), F.col("line_no"))).over(Window.partitionBy(key)), F.lit(1 << 30))
    rows = rows.withColumn("stop", stop).where("line_no is null or line_no = 0 or line_no < stop")
    rows = rows.withColumn("next", F.when(F.col("line_no") + 1 < F.col("stop"), F.col("next")))
    return rows.withColumn("inside", F.coalesce((F.col("line_no") < F.col("stop")) & N.heading_kind(rules).isNull(), F.lit(False)))


def headers(docs: DataFrame, key: str, text: str, name: str | None = None, rules: Rules | None = None) -> DataFrame:
    """(key, title, author, intro, skipped) of each text; title and author fall back to the source's name. Keys are unique."""
    rules = rules or Rules()
    rows = _classified(_prelude(docs, key, text, F.col(name) if name else F.lit(None).cast("string"), rules))
    whole, ordered = Window.partitionBy(key), Window.partitionBy(key).orderBy("line_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    n, s, full = F.col("line_no"), F.col("bare"), F.col("inside") & (F.col("bare") != "")
    is_a = lambda what: F.coalesce(full & (F.col("what") == what), F.lit(False))

    # Blocks, and the first label of an introduction in each and in all.
    rows = rows.withColumn("block", F.count_if(F.col("inside") & (s == "")).over(ordered))
    in_block = Window.partitionBy(key, "block")
    rows = rows.withColumns({"opens": F.min(F.when(is_a("intro"), n)).over(in_block), "ends": F.max(F.when(full, n)).over(in_block), "first": F.min(F.when(is_a("intro"), n)).over(whole)})
    hanging = F.max((n == F.col("first")) & (n == F.col("ends")) & (F.col("value") == "")).over(whole)
    after = F.min(F.when(full & (n > F.col("first")), F.col("block"))).over(whole)
    rows = rows.withColumn("taken", F.when(hanging, after))
    rows = rows.withColumn("told", F.coalesce(full & ((n > F.col("opens")) | (F.col("block") == F.col("taken"))), F.lit(False)))

    # Labels, bare labels and the lines with a colon that answer them.
    labelled = full & ~F.col("told") & F.col("what").isNotNull()
    armed = labelled & F.col("what").isin("title", "author") & (F.col("value") == "")
    colon = full & ~F.col("told") & F.col("what").isNull() & s.rlike("^[:：]")
    rows = rows.withColumn("event", F.when(armed, F.col("what")).when(colon, ""))
    rows = rows.withColumn("asked", F.when(colon, F.nullif(F.last("event", ignorenulls=True).over(before), F.lit(""))))
    gives = F.when(labelled & (F.col("what") != "intro"), F.struct(F.col("what").alias("field"), F.col("value").alias("of"))).when(F.col("asked").isNotNull(), F.struct(F.col("asked").alias("field"), X.strip(F.substring(s, 2, 1 << 30)).alias("of")))
    rows = rows.withColumns({"labelled": labelled, "gives": F.when(gives["of"] != "", gives)})

    # A title in brackets counts as long as there is none.
    wrapped = full & ~F.col("told") & ~labelled & F.col("asked").isNull() & (F.length(s) > 2) & s.startswith("《") & s.endswith("》")
    rows = rows.withColumn("wrapped", wrapped)
    titled = F.coalesce(F.bool_or(F.col("wrapped") | F.coalesce(F.col("gives.field") == "title", F.lit(False))).over(before), F.lit(False))
    rows = rows.withColumn("named", F.col("wrapped") & ~titled)

    # The other lines are candidates; those that the rules skip count, too.
    loose = full & ~F.col("told") & ~F.col("labelled") & F.col("asked").isNull() & ~F.col("named")
    rows = rows.withColumn("seq", F.count_if(loose).over(ordered)).withColumn("loose", loose & (F.col("seq") <= CANDIDATES) & ~s.rlike(f"(?U){rules.skipped}"))

    line = F.struct(n, s.alias("text"))
    last = lambda field: F.max_by(F.col("gives.of"), F.when(F.col("gives.field") == field, n))
    intro = F.when(F.col("told"), s).when(F.col("labelled") & (F.col("what") == "intro"), F.nullif("value", F.lit("")))
    heads = rows.groupBy(key).agg(
        F.first("_name").alias("_name"), last("title").alias("by_label"), last("author").alias("author"),
        F.min_by(X.strip(F.expr("substring(bare, 2, length(bare) - 2)")), F.when(F.col("named"), n)).alias("by_bracket"),
        F.sort_array(F.collect_list(F.when(F.col("loose"), line))).alias("loose"),
        F.transform(F.sort_array(F.collect_list(F.when(intro.isNotNull(), F.struct(n, intro.alias("text"))))), lambda x: x["text"]).alias("intro"),
        F.collect_list(F.when(F.col("told") | F.col("labelled") | F.col("asked").isNotNull() | F.col("named"), n)).alias("used"),
    )
    one, two = F.get("loose", 0), F.get("loose", 1)
    heads = heads.withColumn("told", F.coalesce("by_label", "by_bracket")).withColumn("title", F.coalesce("told", one["text"]))
    by_place = F.when(F.col("author").isNull() & (two["text"] != F.coalesce("title", F.lit(""))), two)
    heads = heads.withColumn("place", by_place).withColumn("h_author", F.coalesce("author", "place.text"))
    used = F.array_compact(F.concat("used", F.array(F.when(F.col("told").isNull(), one["line_no"]), F.col("place.line_no"))))
    by_name, its_author = X.title_from_name("_name")
    told = F.when(X.id_key("title") != "", F.col("title"))
    return heads.select(
        key,
        F.coalesce(told, by_name, X.present("title"), X.present("_name"), F.lit("未命名")).alias("title"),
        F.coalesce(X.present("h_author"), its_author).alias("author"),
        X.present(X.strip(F.array_join("intro", "\n"))).alias("intro"),
        F.array_sort(used).alias("skipped"),
    )


def parsed(docs: DataFrame, key: str, text: str, name: str | None = None, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """Headers and sections of texts. Header lines leave the body first, so a heading's neighbours are the body's."""
    rules = rules or Rules()
    head = headers(docs, key, text, name, rules)
    body = N.lines_of(docs, key, text).join(head.select(key, "skipped"), key).where(~F.array_contains("skipped", F.col("line_no"))).select(key, "line_no", "line")
    return head.drop("skipped"), N.sections(body, key, rules)
