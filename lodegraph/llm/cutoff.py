"""Problem 10: texts cut off by field limits or lost ends, and how often each source does it.

For every source the histogram of lengths, in characters and in bytes, is tested for a spike at its end: many texts within a
few units of the longest.  A text at such a length without terminal punctuation is cut by the limit.

Texts also lose their ends in transfer, at any length, where no histogram tells.  They are a class of their own: away from
spikes a text is cut if its end neither closes a sentence nor is one of the line kinds that need no full stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Marks that stand for lost text, closing punctuation, sign-offs and closing notes that need none.
LOST_MARK = r"(?:\[\s*(?:truncated|cut|snip|more|\.\.\.|…)\s*\]|\((?:truncated|cut off|continued)\)|<truncated>|…|\.{3,})\s*$"
CLOSED = r"[.!?。！？؟][\"'”’»)\]*_`]*\s*$"
SIGN_OFF = r"(?i)^\s*(?:--\s*\S.*|(?:best|regards|best regards|kind regards|cheers|thanks|thank you|yours|sincerely|love|viele grüße|liebe grüße|mit freundlichen grüßen|gruß|grüße|cordialement|bien à vous|saludos|un saludo|atentamente|un abrazo|amicalement)\b[^.]{0,40}|sent (?:by|from|via) (?:the |my )?\w+(?: \w+){0,2}|[(\[](?:end|fin|ende)[^)\]]*[)\]]|eof|the end|end)\s*$"
LIST_ITEM = r"^\s*(?:[-*+•]|\d{1,3}[.)]|\[[ xX]\])\s+(?:\[[ xX]\]\s+)?\S"
LIST_PREFIX = r"^\s*(?:[-*+•]|\d{1,3}[.)]|\[[ xX]\])\s+(?:\[[ xX]\]\s+)?"
TAGS = r"^\s*(?:#[\p{L}\p{N}_/-]+\s*)+$"
PATH = r"^\s*(?:[\w.~-]*/)+[\w.-]+\.\w{1,5}\s*$|^\s*https?://\S+\s*$"
TOTAL = r"^\s*[\p{L}][\p{L} ]{0,30}:\s*[\d.,]+(?:\s\S+){0,3}\s*$"
HEADING = r"^\s*#{1,6}\s+\S"
TABLE = r"^\s*\|.*\|\s*$"
#: Short sentences that end in an ellipsis by custom.
ASIDE = r"(?:^|\s)(?:More (?:later|soon|to come|tomorrow|below)|We(?:'ll| shall| will) see|To be continued|And so on|Who knows|Fortsetzung folgt|Mehr später|Mal sehen|Wir werden sehen|À suivre|On verra|Continuará|Ya veremos)$"
#: Words that cannot end a sentence, English, German, Spanish and French.
DANGLING = r"(?i)(?:^|\s)(?:the|a|an|and|or|of|to|in|on|at|by|for|with|from|that|this|if|so|why|is|der|die|das|und|oder|ein|eine|einer|mit|von|im|am|zum|zur|für|bei|el|la|los|las|un|una|y|o|de|del|con|para|por|le|les|du|des|une|et|ou|pour|avec|dans|sur)$"


SPACE = " \t\r\n\f\v\u00a0"


def ends(df: DataFrame, text: Column) -> DataFrame:
    """The frame with what the ending of a text is judged by: `_body` (without outer space at its end), `_last` (its last line), `_tail` (its last 60
    characters), `_odd` (a code fence is open) and `_word` (the word that ends the raw text, empty if none does).

    All are cut from the end by plain string functions; patterns only see a line or a tail, never a whole text.
    """
    x = df.withColumn("_body", F.rtrim(text, F.lit(SPACE)))
    x = x.withColumn("_last", F.substring_index(F.substring_index("_body", "\n", -1), "\r", -1)).withColumn("_tail", F.right("_body", F.lit(60)))
    x = x.withColumn("_odd", ((F.length("_body") - F.length(F.replace("_body", F.lit("```"), F.lit("")))) / 3) % 2 == 1)
    return x.withColumn("_word", F.regexp_extract(F.right(text, F.lit(60)), r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)$", 1))


def complete(last: Column, odd: Column) -> Column:
    """True where the last line ends as its kind may end."""
    item = F.regexp_replace(last, LIST_PREFIX, "")
    # A short item that is no sentence under way: sentences open with a capital and run on.
    item_done = last.rlike(LIST_ITEM) & (F.size(F.split(F.trim(item), r"\s+")) <= 6) & ~item.rlike(r"^\p{Lu}\S*\s+\S") & ~item.rlike(DANGLING)
    return F.when(odd, False).otherwise(last.endswith("```") | last.rlike(SIGN_OFF) | item_done | last.rlike(TAGS) | last.rlike(PATH) | last.rlike(TOTAL) | last.rlike(HEADING) | last.rlike(TABLE))


def ending() -> Column:
    """Of a frame from `ends`: `none` (no text), `closed`, `trailing` (an ellipsis that ends a whole sentence), `line` (a kind that needs no full stop), `item` (a long list item, undecided), `mark` (a mark for lost text), `open`."""
    body, last, tail = F.col("_body"), F.col("_last"), F.col("_tail")
    unmarked = F.rtrim(F.regexp_replace(tail, LOST_MARK, ""), F.lit(SPACE))
    dots = tail.rlike(r"(?:…|\.{3})$")
    # "More later…" is a whole sentence whose ellipsis is its full stop.
    aside = dots & unmarked.rlike(ASIDE)
    return (
        F.when(body.isNull() | (body == ""), "none")
        .when(aside | (dots & unmarked.rlike(CLOSED)), "trailing")
        .when(tail.rlike(LOST_MARK), "mark")
        .when(tail.rlike(CLOSED), "closed")
        .when(complete(last, F.col("_odd")), "line")
        .when((F.col("_word") != "") & last.rlike(LIST_ITEM), "item")
        .otherwise("open")
    )


def spikes(df: DataFrame, source: str, lengths: list[str], near: int = 0, least: int = 8, factor: float = 6.0) -> DataFrame:
    """(source, unit, spike, n): lengths at the end of a source's histogram that hold far more texts than usual.

    A spike is the longest length, or a length within 4 units below it (a cut between bytes of one character), with at
    least `least` texts and `factor` times the mean of the source's used lengths.  Histograms are aggregated before they
    are compared; their size follows the number of distinct lengths, not of texts.
    """
    long = df.select(F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("len")) for u in lengths])).alias("x")).select("source", "x.*").where("len > 0")
    hist = long.groupBy("source", "unit", "len").count()
    top = hist.groupBy("source", "unit").agg(F.max("len").alias("top"), F.avg("count").alias("usual"))
    return hist.alias("h").join(top.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")) & (F.col("h.unit") == F.col("t.unit"))).where((F.col("len") >= F.col("top") - 4) & (F.col("count") >= least) & (F.col("count") >= factor * F.col("usual"))).select("h.source", "h.unit", F.col("len").alias("spike"), F.col("count").alias("n"))


def flagged(df: DataFrame, rec_id: Column, text: Column, source: Column) -> DataFrame:
    """(rec_id, source, n_chars, n_bytes, ending, at_limit, cause, truncated) for every record.

    cause: `limit` for texts at a spike of their source's lengths unless their end is closed, trailing or a complete line that can't be cut short
    by chance (a whole path, a closed code fence); `ending` for texts off all spikes whose end is open or marked as lost; else
    null.  truncated: there is a cause.  Null, empty and blank texts are never truncated; records with a null source
    form a source of their own; repeated rows are kept and judged alike.
    """
    x = ends(df.select(rec_id.alias("rec_id"), source.cast("string").alias("source"), text.alias("_text")), F.col("_text"))
    base = x.select("rec_id", "source", F.length("_text").alias("n_chars"), F.octet_length("_text").alias("n_bytes"), ending().alias("ending"), F.coalesce(F.col("_last").rlike(PATH) | F.col("_last").endswith("```"), F.lit(False)).alias("_sure"), "_word")
    # What is known of each text is small and is needed three times: it is stored once.
    base = Workspace(df.sparkSession, "cutoff").save(base)
    # A long item without a full stop is complete if texts of this collection end sentences or lines with its last word.
    doubt = base.where("ending = 'item'").select(F.col("_word").alias("word")).distinct()
    finals = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.rtrim(text, F.lit(SPACE)), F.lit(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)[.!?\r\n]"), F.lit(1)))).alias("word"))
    final = finals.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").join(doubt, "word", "left_semi").select(F.col("word").alias("_final"))
    base = base.join(final, (F.col("_word") == F.col("_final")) & (F.col("ending") == "item"), "left").withColumn("ending", F.when(F.col("ending") == "item", F.when(F.col("_final").isNotNull(), "line").otherwise("open")).otherwise(F.col("ending")))
    found = spikes(base, "source", ["n_chars", "n_bytes"])
    # One row per source: its limits, at most five lengths a unit.
    limits = found.groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "n_chars", F.col("spike"))).alias("c"), F.collect_set(F.when(F.col("unit") == "n_bytes", F.col("spike"))).alias("b"))
    out = base.alias("x").join(limits.alias("l"), F.col("x.source").eqNullSafe(F.col("l.source")), "left")
    at = F.coalesce(F.array_contains("l.c", F.col("n_chars").cast("long")) | F.array_contains("l.b", F.col("n_bytes").cast("long")), F.lit(False))
    by_limit = at & (F.col("ending").isin("open", "mark") | ((F.col("ending") == "line") & ~F.col("_sure")))
    cause = F.when(by_limit, "limit").when(~at & F.col("ending").isin("open", "mark"), "ending")
    return out.select("rec_id", "x.source", "n_chars", "n_bytes", "ending", at.alias("at_limit"), cause.alias("cause"), cause.isNotNull().alias("truncated"))


def rates(flags: DataFrame) -> DataFrame:
    """Per source: texts, truncated ones, those that a limit cut, those that lost their end otherwise, and the share."""
    return flags.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("truncated").alias("n_truncated"), F.count_if(F.col("cause") == "limit").alias("n_at_limit"), F.count_if(F.col("cause") == "ending").alias("n_ending"), F.round(F.count_if("truncated") / F.count("*"), 6).alias("share"))
