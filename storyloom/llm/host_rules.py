"""Quality rules with verdicts on whole hosts (operator 3)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, join_back, map_text, materialize

MIN_WORDS = 50
#: A document fails if more than this share (in hundredths) of its words repeat.
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bytes of a host's verdict besides its name.
HOST_BYTES = 64
#: Bounds on the prior's strength, in documents.
STRENGTH = (1.0, 1e6)

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\v\f\r"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in repeated 3-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, upto = Counter(windows), 0
        for k, window in enumerate(windows):
            if counts[window] > 1:
                repeated += k + 3 - max(k, upto)
                upto = k + 3
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case; of any other value the value itself, and of a null an empty one."""
    found = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), url.cast("string"), F.lit(""))


def host_verdicts(rows: DataFrame) -> tuple[DataFrame, bool, int]:
    """From ``__host`` and ``base_failed``: number, failures, shrunk rate and verdict of each host.

    The prior is a beta distribution fitted to all hosts by moments: its mean is the overall
    failure rate, and its strength follows from how much more the hosts' rates vary than chance
    alone would make them. Hosts with few documents are so drawn towards the overall rate.
    """
    hosts = rows.groupBy("__host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures")
    )
    docs, fails, count, squares, chars = hosts.agg(
        F.sum("host_docs"), F.sum("host_failures"), F.count(F.lit(1)),
        F.sum(F.col("host_failures") * F.col("host_failures") / F.col("host_docs")), F.sum(F.length("__host")),
    ).first()
    mean = (fails or 0) / docs if docs else 0.0
    chance = mean * (1 - mean)
    spread = (squares / docs - mean * mean - chance * count / docs) if docs else 0.0
    strength = min(max(chance / spread - 1, STRENGTH[0]), STRENGTH[1]) if spread > 0 else STRENGTH[1]
    rate = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    verdicts = hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= MAX_HOST_RATE)
    return verdicts, count * HOST_BYTES + (chars or 0) * 4 <= BROADCAST_BYTES, docs or 0


def evaluate(
    docs: DataFrame, host: Column | str = "source", carry: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``carry`` and, of each row: its measures, ``base_failed``, its host's rate, and ``kept``.

    A text fails with under 50 words, or if more than half of its words lie in 3-word windows
    that the text holds twice or more. ``kept`` is false for it; else it is its host's verdict.
    A null or empty text has no words and fails; a very long one is measured whole. The host is
    that of the URL in ``host``, or else its whole value; rows of a null one belong to the host "".
    Repeated rows each count. An output column replaces an input column of its name. An empty
    table gives an empty one.

    Measures are written to the shared folder once. Failures are summed before the shuffle, so a
    host with a third of all rows is one row of it; verdicts go back by a broadcast if their
    size, which is counted first, is under ``BROADCAST_BYTES``, and else only those of hot hosts do.
    """
    source = docs.withColumn("__host", host_of(F.col(host) if isinstance(host, str) else host))
    fields = [T.StructField(c, T.LongType()) for c in _FIELDS]
    made = map_text(source, lambda: lambda texts: list(zip(*map(measures, texts), strict=True)), fields, text_col, [*carry, "__host"])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = materialize(made.withColumn("base_failed", failed), "rules")
    verdicts, small, total = host_verdicts(rows)
    rows = rows.drop("host_docs", "host_failures", "host_rate", "host_kept", "kept")
    # A small table goes to every task, so texts need no shuffle by host.
    told = rows.join(F.broadcast(verdicts), "__host") if small else join_back(rows, verdicts.withColumn("__n", F.col("host_docs")), "__host", "__n", total)
    return told.drop("__host").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
