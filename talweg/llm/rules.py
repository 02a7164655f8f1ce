"""Quality rules, line first: lines that fail a rule go, then documents that lost too much go. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import BLANK_CHARS

#: The base rules of a document.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: A line fails if more than this share of its characters are symbols or repeated exclamation and question marks ...
MOST_SYMBOL_PERCENT = 10
NOISE = r"[#*$%&|<>{}\\~^=]|!!|\?\?"
#: ... or if it is navigation: short, and begins with or consists of menu words of the corpus's languages ...
NAVIGATION = (
    r"(?iu)\A[ \t]*(home|menu|login|log in|sign in|sign up|register|search|share|print|next|previous|back to top|skip to content|read more|click here|contact us|about us|sitemap"
    r"|startseite|menü|anmelden|registrieren|suche|teilen|drucken|weiter|zurück|nach oben|zum inhalt springen|weiterlesen|mehr lesen|kontakt|über uns|impressum"
    r"|accueil|connexion|se connecter|inscription|rechercher|partager|imprimer|suivant|précédent|haut de page|aller au contenu|lire la suite|nous contacter|à propos|plan du site"
    r"|inicio|menú|iniciar sesión|registrarse|buscar|compartir|imprimir|siguiente|anterior|volver arriba|ir al contenido|leer más|contáctenos|quiénes somos|mapa del sitio)"
    r"([ \t]*([|>»/·-][^\n]*)?)?[ \t\r]*\z"
)
#: ... or is a bar of links: so many separators at least, and one for every three words or separators ...
SEPARATORS = "[|»›•]"
LEAST_SEPARATORS = 4
#: ... or if it is boilerplate: legal and technical notices in these languages.
NOTICES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookies", "cookie policy", "copyright (c)", "copyright(c)", "©", "subscribe to our", "lorem ipsum", "javascript", "licensed under", "permission is hereby granted",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "newsletter abonnieren",
    "tous droits réservés", "conditions générales", "politique de confidentialité", "mentions légales", "abonnez-vous",
    "todos los derechos reservados", "términos y condiciones", "política de privacidad", "aviso legal", "suscríbase",
)
#: Without the failed lines, a document keeps at least this share of its words.
LEAST_KEPT_PERCENT = 70

#: Bits of a sorted key that hold a window's place; the others hold part of its hash.
PLACE_BITS = 24


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, bound as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def _covered(places: Column, width: int = 3) -> Column:
    """How many places lie in the windows of ``width`` that begin at the sorted places."""
    n = F.size(places)

    def gaps(p: Column) -> Column:
        later = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
        inner = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), later, lambda a, b: F.least(b - a, F.lit(width).cast("bigint")))
        return F.aggregate(inner, F.lit(width).cast("bigint"), lambda s, x: s + x)

    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(_let(places, gaps))


def _repeats_by_hash(words: Column) -> Column:
    """Places of windows that occur twice or more, or null if two different windows share a key.

    Windows are sorted as numbers, the hash above the place, so equal windows are neighbours. Neighbours with
    the same hash are compared word by word.
    """
    mask = (1 << PLACE_BITS) - 1

    def places(keys: Column, w: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            """0: other hash, 1: equal windows, 2: other words under one hash."""
            a, b = keys[i], keys[j]
            p, q = a.bitwiseAND(F.lit(mask)).cast("int"), b.bitwiseAND(F.lit(mask)).cast("int")
            equal = (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])
            return F.when(F.shiftright(a, PLACE_BITS) != F.shiftright(b, PLACE_BITS), 0).when(equal, 1).otherwise(2)

        n = F.size(keys)
        next_same = F.transform(F.sequence(F.lit(0), n - 2), lambda i: same(i, i + 1))

        def chosen(s: Column) -> Column:
            marked = F.filter(keys, lambda k, i: ((i < n - 1) & (s[F.least(i, n - 2)] == 1)) | ((i > 0) & (s[F.greatest(i - 1, F.lit(0))] == 1)))
            return F.when(F.array_contains(s, 2), F.lit(None)).otherwise(F.sort_array(F.transform(marked, lambda k: k.bitwiseAND(F.lit(mask)))))

        return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(_let(next_same, chosen))

    def keyed(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), PLACE_BITS).bitwiseOR(i.cast("bigint")))
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(_let(F.sort_array(keys), lambda k: places(k, w)))

    return _let(words, keyed)


def _repeats_by_words(words: Column) -> Column:
    """The same by sorting the windows' words themselves; for the texts that the hash can't decide."""

    def keyed(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.cast("bigint").alias("p")))

        def chosen(s: Column) -> Column:
            def equal(i: Column, j: Column) -> Column:
                return (s[i]["a"] == s[j]["a"]) & (s[i]["b"] == s[j]["b"]) & (s[i]["c"] == s[j]["c"])

            n = F.size(s)
            marked = F.filter(s, lambda x, i: ((i < n - 1) & equal(i, F.least(i + 1, n - 1))) | ((i > 0) & equal(F.greatest(i - 1, F.lit(0)), i)))
            return F.sort_array(F.transform(marked, lambda x: x["p"]))

        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(_let(F.sort_array(windows), chosen))

    return _let(words, keyed)


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the text, the first occurrence included."""
    fast = F.when(F.size(words) < (1 << PLACE_BITS), _repeats_by_hash(words))
    return _let(fast, lambda p: _covered(F.when(p.isNotNull(), p).otherwise(_repeats_by_words(words))))


def folded(text: Column) -> Column:
    """Lower case, with the long s as what its upper case is."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def has_notice(text: Column) -> Column:
    """Whether a folded text contains a notice."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in NOTICES))


def line_fails(line: Column, notices: Column) -> Column:
    """Punctuation, navigation and boilerplate rules of a line with at least one word; ``notices``: whether its text has any notice."""
    noisy = 100 * F.regexp_count(line, F.lit(NOISE)) > MOST_SYMBOL_PERCENT * F.length(line)
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    menu = (bars >= LEAST_SEPARATORS) & (3 * bars >= F.regexp_count(line, F.lit(r"[^ \t-\r]+")))
    return noisy | menu | line.rlike(NAVIGATION) | (notices & has_notice(folded(line)))


def clean(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, base columns, base_failed, clean_text, n_clean_words, kept), a row per row.

    Null texts count as empty: no words, base_failed, not kept, clean text empty. Very long texts are one row's
    arrays. Repeated rows come out repeatedly, an empty table gives none, other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("f", folded(F.col("t")))
    base = base.select("doc_id", "t", has_notice(F.col("f")).alias("notices"), _words(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counted = base.withColumn("lines", lines).select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.array_join(F.filter("lines", lambda x: ~line_fails(x, F.col("notices"))), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).withColumn("n_clean_words", F.regexp_count("clean_text", F.lit(r"[^ \t-\r]+")).cast("bigint"))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_clean_words") >= LEAST_KEPT_PERCENT * F.col("n_words")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i AS p, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM s)
), m AS (
  SELECT r, p FROM g QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), n AS (
  SELECT r, CAST(count(DISTINCT q) AS BIGINT) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM m) GROUP BY r
), c AS (
  SELECT r, list_filter(ls, lambda x: NOT (
      100 * len(regexp_extract_all(x, '[#*$%&|<>{}\\~^=]|!!|\?\?')) > 10 * length(x)
      OR len(regexp_extract_all(x, '[|»›•]')) >= 4 AND 3 * len(regexp_extract_all(x, '[|»›•]')) >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
      OR regexp_matches(x, '(?i)\A[ \t]*(home|menu|login|log in|sign in|sign up|register|search|share|print|next|previous|back to top|skip to content|read more|click here|contact us|about us|sitemap|startseite|menü|anmelden|registrieren|suche|teilen|drucken|weiter|zurück|nach oben|zum inhalt springen|weiterlesen|mehr lesen|kontakt|über uns|impressum|accueil|connexion|se connecter|inscription|rechercher|partager|imprimer|suivant|précédent|haut de page|aller au contenu|lire la suite|nous contacter|à propos|plan du site|inicio|menú|iniciar sesión|registrarse|buscar|compartir|imprimir|siguiente|anterior|volver arriba|ir al contenido|leer más|contáctenos|quiénes somos|mapa del sitio)([ \t]*([|>»/·-][^\n]*)?)?[ \t\r]*\z')
      OR regexp_matches(x, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie(s| policy)|copyright ?(\(c\)|©)|©|subscribe to our|lorem ipsum|javascript|licensed under|permission is hereby granted|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|allgemeine geschäftsbedingungen|newsletter abonnieren|tous droits réservés|conditions générales|politique de confidentialité|mentions légales|abonnez-vous|todos los derechos reservados|términos y condiciones|política de privacidad|aviso legal|suscríbase)'))) AS ok
  FROM s
), b AS (
  SELECT s.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(n.n, 0) AS n_repeat_words,
         CAST(len(regexp_extract_all(array_to_string(ok, chr(10)), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_clean_words
  FROM s JOIN c USING (r) LEFT JOIN n USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_clean_words >= 70 * n_words AS kept,
       n_clean_words
FROM b
"""
