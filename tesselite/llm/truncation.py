"""Texts cut off by field limits: word trigrams that go on inside texts but hardly ever end one.

In pure SQL. A text is split into its turns and tokenised into words and signs. In prose something ends
at every sentence end, list item and empty line; in code only where the text ends, and a line break is a
token like any other. For each turn's final trigram three tables of trigrams tell how often it stands in
all texts and how often something ends after it:

* the three words themselves,
* the last word after the folded words before it,
* all three folded.

A folded word is itself if it is one of the `closed_words` most frequent ones of letters, and else its shape
(letters, digits, mixed), so `although every <word>` is judged even where this very word was never met there. The
first of these trigrams that is frequent enough decides: frequent is one after which `expected` ends would
be met at the average rate of its kind, and it is almost never terminal if they are at most `share` of
that. The turn's own end is left out. A final word that is hardly ever met whole is read as the beginning
of words instead: if the trigrams that it begins are met inside texts, it was cut within the word.

What the trigrams leave open is refined by the folded five-gram in the same way, by words alone, and by
rules: an open bracket in code, a marker of truncation or a decoding error, and a length that far more
texts of a category have than have lengths around it (a field limit), without an end there. `reason` tells
which it was; `trigram` and `trigram within a word` stand before the others.

All statistics are over distinct texts of a kind, so copies, in whatever category and under whatever
id, don't acquit each other or make a length frequent; the verdict goes to every id of a text. Verdicts
are found once per distinct ending, so an ending that a third of all texts share is one row in every
join, and go back to the texts by a salted join. The frequent words are at most `closed_words`.

Defined results: NULL and blank texts are complete; repeated rows count once;
texts of any length are read whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.session import materialize

#: Regexes, given to the SQL as parameters.
PATTERNS = {
    # a run of letters and digits, or one sign
    "token": r"[a-z0-9\p{L}\p{N}]+|[^\s\p{L}\p{N}]",
    # what ends something in prose: sentence signs before white space, the next list item, an empty line
    "breaks": r"[.!?…]+(?=\s|$)|\n(?=\s*(?:[-*•]|\p{N}+[.)])\s)|\n\s*\n",
    "turns": r"\n+(?=(?:User|Assistant): )",
    "marker": r"(?i)(?:\x{FFFD}|…\s*[(\[](?:truncated|cut off|continued)[)\]])$",
    "tail": r"(?i)(?:\s|\x{FFFD}|…\s*[(\[](?:truncated|cut off|continued)[)\]])+$",
    "speaker": r"^\s*(?:User|Assistant):",
    # literals and remarks, inside which brackets do not count
    "quoted": r'"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|#[^\n]*",
    "letters": r"^\p{L}+$",
    "digits": r"(?<![\p{L}\p{N}])[0-9\p{N}]+(?![\p{L}\p{N}])",
    "mixed": r"(?<![\p{L}\p{N}])(?=\p{L}*\p{N})[a-z0-9\p{L}\p{N}]+",
}
LONG = 5  # tokens of the refining n-gram
#: What stands for the shapes of words: letters, digits, mixed. Signs that are no letters, so that each stays one token.
W, D, X = "", "", ""
_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

_OPEN = " OR ".join(f"length(replace(bare, '{a}', '')) < length(replace(bare, '{b}', ''))" for a, b in (("{{", "}}"), ("(", ")"), ("[", "]")))

SEGMENTS = f"""
SELECT doc, kind, code, last_turn, marked_cut, stopped, open, ended, trim(' ¶' FROM concat_ws(' ', regexp_extract_all(lower(marked), :token, 0))) AS t
FROM (SELECT doc, kind, code, last_turn, marked_cut, NOT marked_cut AND right(cut, 1) IN ('.', '!', '?') AND right(cut, 2) <> '..' AS stopped,
    IF(code, right(cut, 1) = '}}}}', right(cut, 1) IN ('.', '!', '?', '…')) AS ended, code AND ({_OPEN} OR size(split(cut, :doc)) % 2 = 0) AS open,
    IF(code, replace(cut, chr(10), ' ↵ '), regexp_replace(IF(cut RLIKE :speaker, regexp_replace(cut, :speaker, ''), cut), :breaks, ' ¶ ')) AS marked
  FROM (SELECT *, IF(code, regexp_replace(cut, :quoted, ''), '') AS bare
    FROM (SELECT *, IF(marked_cut, regexp_replace(raw, :tail, ''), raw) AS cut
      FROM (SELECT *, raw RLIKE :marker AS marked_cut
        FROM (SELECT doc, kind, code, turn = n_turns - 1 AS last_turn, rtrim({_SPACE}, raw) AS raw
          FROM (SELECT doc, kind, code, size(turns) AS n_turns, posexplode_outer(turns) AS (turn, raw)
            FROM (SELECT doc, kind, code, IF(code, array(text), split(text, :turns)) AS turns
              FROM (SELECT doc, kind, code, translate(text, '¶↵{W}{D}{X}', '     ') AS text FROM {{texts}}))))))))
"""

#: Words with how often they stand in texts and how often something ends after them.
WORDS = """
SELECT kind, code, p.t AS word, count(*) AS n, count_if(p.following = '¶') AS ends
FROM (SELECT kind, code, explode(arrays_zip(t, following)) AS p FROM (SELECT kind, code, t, concat(slice(t, 2, size(t)), array('¶')) AS following FROM (SELECT kind, code, split(t, ' ') AS t FROM {segments} WHERE t <> '')))
WHERE p.t <> '¶' GROUP BY 1, 2, 3
"""


def _folding(closed: list[str]) -> str:
    """What a folded word is: letters, but none of the frequent words."""
    known = f"(?!(?:{'|'.join(closed)})(?![\\p{{L}}\\p{{N}}]))" if closed else ""
    return rf"(?<![\p{{L}}\p{{N}}]){known}[a-z\p{{L}}]+(?![\p{{L}}\p{{N}}])"


_FOLDED = f"regexp_replace(regexp_replace(regexp_replace(t, :digits, '{D}'), :mixed, '{X}'), IF(code, :fold_code, :fold_other), '{W}')"
_EXACT, _LONG = "xxhash64(kind, 'W', a2, a1, a0)", f"xxhash64(kind, 'L', {', '.join(f'b{k}' for k in range(LONG))})"
#: A word as it is, digits and mixed words by their shape.
_NAMED = f"CASE b0 WHEN '{X}' THEN concat('x', length(a0)) WHEN '{D}' THEN '0' ELSE a0 END"


def _grams_sql() -> str:
    """n, ends of the n-grams that end at each position of each turn, in one aggregation over numbers.

    Trigrams of words and folded five-grams have their hash k alone; the last word after two folded ones has
    the hash of these as k, and the hashes h of the word and f of its fold beside it. The arrays stay in the row
    that is exploded into positions, so a position reads them and copies nothing.
    """
    none = "CAST(NULL AS BIGINT)"
    a, b = [f"get(w, i - {k})" for k in range(3)], [f"get(c, i - {k})" for k in range(LONG)]
    exact, long = (x.replace("a2, a1, a0", ", ".join(a[::-1])).replace(", ".join(f"b{k}" for k in range(LONG)), ", ".join(b)) for x in (_EXACT, _LONG))
    rows = f"""stack(3, {exact}, {none}, {none}, IF(i < {LONG - 1}, NULL, {long}), {none}, {none}, xxhash64(kind, {b[2]}, {b[1]}), xxhash64({_NAMED.replace("a0", a[0]).replace("b0", b[0])}), xxhash64({b[0]})) AS (k, h, f)"""
    return f"""
SELECT k, h, f, count(*) AS n, count_if(ends) AS ends
FROM (SELECT coalesce(get(w, i + 1), '¶') = '¶' AS ends, {rows}
  FROM (SELECT kind, w, c, explode(sequence(2, size(w) - 1)) AS i
    FROM (SELECT kind, split(concat('¶ ', t), ' ') AS w, split(concat('¶ ', {_FOLDED}), ' ') AS c FROM {{segments}} WHERE t LIKE '% %')) WHERE {a[0]} <> '¶')
WHERE k IS NOT NULL GROUP BY 1, 2, 3
"""


GRAMS = _grams_sql()


def _finals_sql() -> str:
    """The turns with the hash of their ending, and the ending's words."""
    names = ", ".join(f"get(w, size(w) - {k + 1}) AS a{k}" for k in range(3))
    folds = ", ".join(f"get(c, size(c) - {k + 1}) AS b{k}" for k in range(LONG))
    return f"""
SELECT *, xxhash64(kind, a2, a1, a0, b4, b3) AS ending, IF(a2 IS NULL, NULL, {_EXACT}) AS k_exact, IF(b{LONG - 1} IS NULL, NULL, {_LONG}) AS k_long, IF(a2 IS NULL, NULL, xxhash64(kind, b2, b1)) AS before, {_NAMED} AS word
FROM (SELECT doc, kind, code, last_turn, marked_cut, stopped, open, ended, {names}, {folds}
  FROM (SELECT *, split(t, ' ') AS w, split({_FOLDED}, ' ') AS c FROM (SELECT * EXCEPT (t), substring_index(concat('¶ ', t), ' ', -{LONG}) AS t FROM {{segments}} WHERE t <> '')))
"""


FINALS = _finals_sql()


def _decides(names: list[str]) -> str:
    """Whether the first of the n-grams that is frequent enough is almost never terminal; a rarer one that ended something elsewhere acquits."""
    tests = " ".join(f"WHEN (n_{s} - 1) * rate >= :expected THEN e_{s} - 1 <= :share * rate * (n_{s} - 1) WHEN e_{s} > 1 AND n_{s} * :share * rate < e_{s} - 1 THEN false" for s in names)
    return f"(CASE {tests} ELSE false END)"


VERDICTS = f"""
WITH endings AS (SELECT DISTINCT ending, kind, code, k_exact, k_long, before, b0, a0, word, xxhash64(word) AS h, xxhash64(b0) AS f FROM {{finals}}),
rates AS (SELECT kind, sum(ends) / sum(n) AS rate FROM {{words}} GROUP BY kind),
folds AS (SELECT k, f, sum(n) AS n, sum(ends) AS ends FROM {{last_words}} GROUP BY 1, 2),
spelled AS (SELECT DISTINCT xxhash64(word) AS h, word FROM {{words}} WHERE length(word) > 1 AND word RLIKE :letters),
asked AS (SELECT DISTINCT before, word FROM endings WHERE word RLIKE :letters),
begun AS (
  SELECT p.k, p.prefix, sum(p.n) AS n
  FROM (SELECT k, n - ends AS n, explode(transform(sequence(1, length(word) - 1), l -> substring(word, 1, l))) AS prefix
    FROM {{last_words}} t JOIN spelled s ON s.h = t.h WHERE n > ends) p
  LEFT SEMI JOIN asked a ON a.before = p.k AND a.word = p.prefix GROUP BY 1, 2),
parts AS (
  SELECT kind, prefix, max(n) AS n
  FROM (SELECT kind, n - ends AS n, explode(transform(sequence(1, length(word) - 1), l -> substring(word, 1, l))) AS prefix
    FROM {{words}} WHERE n - ends >= :seen AND length(word) > 1 AND word RLIKE :letters) GROUP BY 1, 2),
facts AS (
  SELECT e.ending, e.code, r.rate, coalesce(g.n, 0) AS n_W, coalesce(g.ends, 0) AS e_W, coalesce(t.n, 0) AS n_T, coalesce(t.ends, 0) AS e_T,
    coalesce(f.n, 0) AS n_F, coalesce(f.ends, 0) AS e_F, coalesce(l.n, 0) AS n_L, coalesce(l.ends, 0) AS e_L,
    coalesce(s.n - 1, 0) AS n_word, coalesce(s.ends - 1, 0) AS e_word, coalesce(b.n, 0) AS n_begun, coalesce(p.n, 0) AS n_part,
    e.b0 = '{X}' AND (coalesce(f.n, 0) - 1) * r.rate >= :expected AND coalesce(t.n, 0) - 1 <= 0.01D * f.n AS odd_length
  FROM endings e JOIN rates r ON r.kind = e.kind
  LEFT JOIN {{grams}} g ON g.k = e.k_exact
  LEFT JOIN {{last_words}} t ON t.k = e.before AND t.h = e.h AND t.f = e.f
  LEFT JOIN folds f ON f.k = e.before AND f.f = e.f
  LEFT JOIN {{grams}} l ON l.k = e.k_long
  LEFT JOIN {{words}} s ON s.kind = e.kind AND s.word = e.a0
  LEFT JOIN begun b ON b.k = e.before AND b.prefix = e.word
  LEFT JOIN parts p ON p.kind = e.kind AND p.prefix = e.a0)
SELECT ending, CASE
  WHEN n_begun >= :seen AND (n_word - e_word) * 100 <= greatest(n_part, n_begun) OR odd_length THEN 'trigram within a word'
  WHEN n_word >= 5 AND e_word >= 0.5D * n_word THEN NULL
  WHEN {_decides(["W", "T", "F"])} THEN 'trigram'
  WHEN n_part > 0 AND (n_word - e_word) * 100 <= n_part THEN 'part of a word'
  WHEN {_decides(["L"])} THEN 'longer n-gram'
  END AS said FROM facts
"""

JUDGED = """
WITH lengths AS (SELECT code, category, n_chars, count(*) AS n FROM (SELECT DISTINCT doc, code, category, n_chars FROM {owners}) GROUP BY 1, 2, 3),
around AS (SELECT code, category, n, n_chars AS other, explode(sequence(n_chars - 20, n_chars + 20)) AS n_chars FROM lengths),
limits AS (
  SELECT a.code, a.category, a.n_chars FROM lengths a
  LEFT JOIN around b ON a.code = b.code AND a.category <=> b.category AND a.n_chars = b.n_chars AND a.n_chars <> b.other
  WHERE a.n >= :least GROUP BY a.code, a.category, a.n_chars, a.n HAVING a.n >= :excess * (coalesce(sum(b.n), 0) / 40 + 0.1D)),
spread AS (SELECT ending, said, explode(sequence(0, :salts - 1)) AS salt FROM {verdicts} WHERE said IS NOT NULL),
turns AS (
  SELECT f.doc, f.code, f.last_turn AND NOT f.ended AS at_end, CASE
    WHEN NOT (f.stopped AND NOT f.code) AND s.said IS NOT NULL THEN s.said
    WHEN f.open THEN 'open bracket' WHEN f.marked_cut THEN 'marker' END AS reason, f.stopped
  FROM (SELECT *, CAST(pmod(xxhash64(doc), :salts) AS INT) AS salt FROM {finals}) f LEFT JOIN spread s ON s.ending = f.ending AND s.salt = f.salt),
cut AS (
  SELECT o.id, coalesce(t.reason, CASE WHEN l.n_chars IS NOT NULL AND t.at_end AND NOT (t.stopped AND NOT t.code) THEN 'at the limit' END) AS reason
  FROM turns t JOIN {owners} o ON o.doc = t.doc
  LEFT JOIN limits l ON t.at_end AND l.code = t.code AND l.category <=> o.category AND l.n_chars = o.n_chars
  WHERE t.reason IS NOT NULL OR t.at_end)
SELECT DISTINCT id, reason FROM cut WHERE reason IS NOT NULL
"""


def truncated(
    entries: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "text",
    kind_col: str = "entry_type",
    category_col: str = "category",
    closed_words: int = 40,
    expected: float = 4.0,
    share: float = 0.1,
    seen: int = 5,
    least: int = 4,
    excess: float = 8.0,
    salts: int = 8,
) -> DataFrame:
    """id, reason: one row per reason of each cut text. Texts of kind `code` are judged as code.

    expected, share: ends that the average rate of the kind must promise after an n-gram for it to be judged,
    and which part of them is still almost never; seen: how often a word must be met to have parts; least,
    excess: texts that a limit's length must have, and how many times as many as lengths around it.
    """
    spark = entries.sparkSession
    texts = entries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(kind_col), F.lit("")).alias("kind"), F.col(category_col).alias("category"))
    texts = texts.where(F.col("id").isNotNull() & (F.length(F.trim("text")) > 0))
    doc, code = F.unhex(F.md5(F.concat_ws("\0", "kind", "text"))).alias("doc"), (F.col("kind") == "code").alias("code")
    owners = materialize(texts.select("id", doc, code, "category", F.length("text").alias("n_chars")).distinct(), "owners")
    own = texts.select("kind", "text").distinct().select(doc, "kind", code, "text")

    def run(query: str, **frames: DataFrame) -> DataFrame:
        values = {**PATTERNS, **folds, "doc": '"""', "expected": expected, "share": share, "seen": seen, "least": least, "excess": excess, "salts": salts}
        return spark.sql(query, args={k: v for k, v in values.items() if f":{k}" in query}, **frames)

    folds: dict[str, str] = {}
    segments = materialize(run(SEGMENTS, texts=own), "segments")
    words = materialize(run(WORDS, segments=segments), "words")
    for name, rows in (("code", words.where("code")), ("other", words.where("NOT code"))):
        frequent = rows.where(F.col("word").rlike(PATTERNS["letters"])).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(closed_words)
        folds[f"fold_{name}"] = _folding([r["word"] for r in frequent.collect()])
    finals = materialize(run(FINALS, segments=segments), "finals")
    all_grams = materialize(run(GRAMS, segments=segments), "all_grams")
    # of the n-grams only those that end a turn are judged
    wanted = finals.select(F.explode(F.array("k_exact", "k_long")).alias("k")).where(F.col("k").isNotNull()).distinct()
    grams = materialize(all_grams.where(F.col("h").isNull()).select("k", "n", "ends").join(wanted, "k", "left_semi"), "grams")
    last_words = all_grams.where(F.col("h").isNotNull())
    verdicts = run(VERDICTS, finals=finals, words=words, last_words=last_words, grams=grams)
    return run(JUDGED, verdicts=verdicts, finals=finals, owners=owners)


def shares(entries: DataFrame, cut: DataFrame, *, id_col: str = "id", category_col: str = "category") -> DataFrame:
    """category (NULL included), n_entries, n_cut, cut_share."""
    rows = entries.select(F.col(id_col).alias("id"), F.col(category_col).alias("category")).distinct()
    marked = rows.join(cut.select("id", F.lit(1).alias("is_cut")).distinct(), "id", "left")
    counted = marked.groupBy("category").agg(F.count("id").alias("n_entries"), F.count("is_cut").alias("n_cut"))
    return counted.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_entries"), 6))
