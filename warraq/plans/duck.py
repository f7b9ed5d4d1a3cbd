"""Pieces of the DuckDB oracles: common table expressions that restate the operators in SQL."""

from __future__ import annotations

from warraq.functions import resources as R
from warraq.operators.rules import surfaces

#: Character classes and token patterns written out anew for RE2, so that a wrong one in the operators shows.
LETTERS = r"\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0671}\x{066E}-\x{06D3}\x{06FA}-\x{06FC}\x{06FF}"
MARKS = r"\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}"
STROKE = r"\x{0640}"
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+"
TOKEN_KINDS = (
    ("code", r"```(?s:.*?)```|`[^`\n]+`"),
    ("url", rf"(?:https?://|ftp://|www\.)[^{BLANK}<>\[\]{{}}\"'`]+"),
    ("email", r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("hashtag", rf"#[{LETTERS}A-Za-z0-9_]+"),
    ("mention", rf"@[{LETTERS}A-Za-z0-9_]+"),
    ("arabic", rf"[{LETTERS}](?:[{LETTERS}{MARKS}{STROKE}]*[{LETTERS}{MARKS}])?"),
    ("number", r"[+\-]?[0-9\x{660}-\x{669}]+(?:[.,\x{66B}\x{66C}][0-9\x{660}-\x{669}]+)*[%\x{66A}]?"),
    ("latin", rf"{LATIN}(?:['\x{{2019}}\-]{LATIN})*"),
    ("whitespace", f"[{BLANK}]+"),
    ("punctuation", r"[\x{060C}\x{061B}\x{061F}.!?,;:\x{2026}]+"),
    ("symbol", f"[^{BLANK}]"),
)
TOKEN = "|".join(f"(?:{p})" for _, p in TOKEN_KINDS)
RUN = f"[{LETTERS}{MARKS}{STROKE}]+|[^{LETTERS}{MARKS}{STROKE}]+"
ENDS = r".!?\x{061F}\x{061B}\x{2026}"
CLOSE = r"\"'\x{BB}\x{201D}\x{2019})\]}"
OPEN = r"(\[{'\"\x{AB}\x{060C}\x{061B}:\x{2014}-"
DIGIT = r"0-9\x{660}-\x{669}"

#: Corrections from which rules are distilled.
FIXES = (("لاكن", "لكن"), ("الطقس جميلا", "الجو رائعا"), ("متاخره", "متأخرة"))


def quoted(s: object) -> str:
    return "'" + s.replace("'", "''") + "'" if isinstance(s, str) else str(s).lower() if isinstance(s, bool) else str(s)


def sql(*parts: str) -> str:
    """All but the last are common table expressions."""
    return (f"WITH {', '.join(parts[:-1])} " if len(parts) > 1 else "") + parts[-1]


def arabic() -> str:
    s = "[" + ", ".join(map(quoted, R.SENTENCES)) + "]"
    n = len(R.SENTENCES)
    return f"s0 AS (SELECT {s} AS s), ar AS (SELECT doc_id, lang, source, concat_ws(' ', s[doc_id % {n} + 1], s[(doc_id // {n} * 7 + doc_id + 1) % {n} + 1], s[(doc_id * 13 + 2) % {n} + 1], text) AS text FROM documents, s0)"


def pieces(pattern: str, source: str, name: str) -> str:
    keep = "lang, source"
    return (
        f"{name}0 AS (SELECT doc_id, {keep}, regexp_extract_all(text, {quoted(pattern)}) AS ps FROM {source}), "
        f"{name}1 AS (SELECT doc_id, {keep}, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS idx FROM {name}0), "
        f"{name} AS (SELECT doc_id, {keep}, piece, idx::BIGINT AS idx, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY idx))::BIGINT AS stop, "
        f"(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY idx) - length(piece))::BIGINT AS start FROM {name}1)"
    )


def tokens(source: str = "documents") -> str:
    """Tokens ``t``; marks at the end of an address are split off."""
    kind = " ".join(f"WHEN regexp_matches(p, {quoted(chr(92) + 'A(?:' + p + ')' + chr(92) + 'z')}) THEN '{k}'" for k, p in TOKEN_KINDS)
    tail = "[.,\\x{060C}\\x{061B}\\x{061F}!]+\\z"
    split = f"CASE WHEN regexp_matches(p, '\\A(?:https?://|ftp://|www\\.)') AND regexp_matches(p, '{tail}') THEN list_concat([{{'p': regexp_replace(p, '{tail}', ''), 'k': 'url'}}], list_transform(string_split(regexp_extract(p, '{tail}'), ''), lambda c: {{'p': c, 'k': 'punctuation'}})) ELSE [{{'p': p, 'k': NULL::VARCHAR}}] END"
    return (
        f"tt0 AS (SELECT doc_id, lang, source, flatten(list_transform(regexp_extract_all(text, {quoted(TOKEN)}), lambda p: {split})) AS ps FROM {source}), "
        "tt1 AS (SELECT doc_id, lang, source, unnest(ps) AS s, generate_subscripts(ps, 1) - 1 AS idx FROM tt0), tt2 AS (SELECT doc_id, lang, source, idx, s.p AS p, s.k AS k FROM tt1), "
        "t AS (SELECT doc_id, lang, source, p AS piece, idx::BIGINT AS idx, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY idx))::BIGINT AS stop, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY idx) - length(p))::BIGINT AS start, "
        f"CASE WHEN k IS NOT NULL THEN k {kind} END AS kind FROM tt2)"
    )


def sentences(source: str = "documents") -> str:
    """Sentences ``sp`` with their bodies: dots that end nothing are masked, then texts fall into ends and what is between them."""
    masked = "coalesce(text, '')"
    for _ in range(2):
        masked = f"regexp_replace({masked}, '([{DIGIT}])\\.([{DIGIT}])', '\\1' || chr(1) || '\\2', 'g')"
    for names in ("أ\\.د|ق\\.م|م\\.م|e\\.g|i\\.e", "د|م|أ|ص|ج|هـ|Dr|Mr|Mrs|Ms|Prof"):
        masked = f"regexp_replace({masked}, {quoted(f'(^|[{BLANK}{OPEN}])({names})')} || '\\.', '\\1\\2' || chr(1), 'g')"
    blank = BLANK.replace("\\t-\\r", "\\t\\x0b-\\r")
    masked = f"regexp_replace({masked}, {quoted(f'(?m)^((?:[{blank}]|[{ENDS}]+[{CLOSE}]*)*(?:[{DIGIT}]{{1,3}}|[A-Za-z' + chr(92) + 'x{623}-' + chr(92) + f'x{{64A}}])[{blank}]*)')} || '\\.', '\\1' || chr(1), 'g')"
    return (
        f"sp0 AS (SELECT doc_id, text, regexp_extract_all({masked}, {quoted(f'{chr(92)}n|[{ENDS}]+[{CLOSE}]*|[^{ENDS}{chr(92)}n]+')}) AS ps FROM {source}), "
        "sp1 AS (SELECT doc_id, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM sp0), "
        "sp2 AS (SELECT *, lead(p) OVER w AS following, (sum(length(p)) OVER w)::BIGINT AS stop, (sum(length(p)) OVER w - length(p))::BIGINT AS start FROM sp1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
        f"sp AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS sent, start, stop, coalesce(following, '') AS terminator, substr(text, start + 1, stop - start) AS body FROM sp2 WHERE NOT regexp_matches(p, {quoted(f'{chr(92)}A[{ENDS}{chr(92)}n]')}) AND regexp_matches(p, {quoted(f'[^{BLANK}]')}))"
    )


def heat() -> str:
    """Sentences with words, complexity and clarity, ``ht``; needs sentences and tokens."""
    return (
        "hw AS (SELECT t.doc_id, sp.sent, count(*)::BIGINT AS words, count(*) FILTER (length(piece) >= 8) AS long_words FROM t ASOF JOIN sp ON t.doc_id = sp.doc_id AND t.start >= sp.start WHERE kind IN ('arabic', 'latin') GROUP BY ALL), "
        "hr AS (SELECT sp.doc_id, sp.sent, start, stop, coalesce(words, 0)::BIGINT AS words, greatest(0, coalesce(words, 0) - 12) * 2.8::DOUBLE + len(regexp_extract_all(body, '[،؛:(]')) * 7.0::DOUBLE + coalesce(long_words, 0) * 1.8::DOUBLE AS raw FROM sp LEFT JOIN hw ON hw.doc_id = sp.doc_id AND hw.sent = sp.sent), "
        "ht AS (SELECT *, least(100.0::DOUBLE, raw) AS c FROM hr)"
    )


def normalize(col: str, mode: str) -> str:
    col = f"nfc_normalize({col})"
    if mode != "strict":
        col = f"regexp_replace({col}, '[{MARKS}{STROKE}]', '', 'g')"
    if mode in ("search", "aggressive"):
        col = f"translate({col}, 'أإآٱىؤئة', 'اااايويه')"
    if mode == "aggressive":
        col = f"trim(regexp_replace(regexp_replace({col}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return col


def respace(col: str) -> str:
    col = f"regexp_replace({col}, '[ \\t]+', ' ', 'g')"
    col = f"regexp_replace({col}, ' ([،؛:,.!?؟])', '\\1', 'g')"
    return f"trim(regexp_replace({col}, '([،؛:]) *', '\\1 ', 'g'))"


def words() -> str:
    return f"w AS (SELECT *, lower(regexp_replace(piece, '[{MARKS}{STROKE}]', '', 'g')) AS form FROM t WHERE kind IN ('arabic', 'latin'))"


def lexicon(name: str, columns: str, rows: tuple) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def hits(where: str = "true") -> str:
    columns = "surface, words, rule_id, suggestion, category, severity, confidence, priority, autofix, profile"
    return (
        f"{pieces(RUN, 'ar', 'u')}, {lexicon('rl', columns, tuple(surfaces()))}, "
        "u2 AS (SELECT *, lead(piece, 1) OVER x AS gap, lead(piece, 2) OVER x AS second FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY idx)), "
        "u3 AS (SELECT doc_id, start, stop, piece AS surface FROM u2 UNION ALL SELECT doc_id, start, stop + 1 + length(second), piece || ' ' || second FROM u2 WHERE gap = ' ' AND second IS NOT NULL), "
        f"h AS (SELECT doc_id, start, stop::BIGINT AS stop, rule_id, suggestion, category, severity, confidence, priority FROM u3 JOIN rl USING (surface) WHERE {where})"
    )


def resolved(source: str = "h", name: str = "r") -> str:
    order = "-priority, -confidence, CASE severity WHEN 'error' THEN -3 WHEN 'warning' THEN -2 ELSE -1 END, CASE WHEN suggestion IS NULL THEN 1 ELSE 0 END, start - stop, start, rule_id"
    kind = "STRUCT(a BIGINT, b BIGINT, r VARCHAR)[]"
    return (
        f"{name}0 AS (SELECT doc_id, list({{'a': start::BIGINT, 'b': stop::BIGINT, 'r': rule_id}} ORDER BY {order}) AS ms FROM {source} GROUP BY doc_id), "
        f"{name}1 AS (SELECT doc_id, list_reduce(list_transform(ms, lambda m: [m]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.a < x[1].b AND x[1].a < k.b)) > 0 THEN acc ELSE list_concat(acc, x) END, CAST([] AS {kind})) AS kept FROM {name}0), "
        f"{name}2 AS (SELECT doc_id, unnest(kept) AS m FROM {name}1), {name} AS (SELECT doc_id, m.a AS start, m.b AS stop, m.r AS rule_id FROM {name}2)"
    )


def check_parts(name: str) -> tuple[str, str]:
    """Common table expressions over ``ar`` and the select of one built-in check."""
    x = "WINDOW x AS (PARTITION BY doc_id ORDER BY idx)"
    if name == "repeated_words":
        return f"{tokens('ar')}, a1 AS (SELECT *, lead(kind) OVER x AS k1, lead(piece, 2) OVER x AS p2, lead(stop, 2) OVER x AS s2 FROM t {x})", "SELECT doc_id, 'STYLE_REPEATED_WORD' AS rule_id, start, s2 AS stop, piece AS suggestion FROM a1 WHERE kind = 'arabic' AND length(piece) > 1 AND k1 = 'whitespace' AND p2 = piece"
    if name == "latin_punct":
        a = f"{pieces(r'[,?;]|\s+|[^,?;\s]+', 'ar', 'b')}, bx AS (SELECT *, lag(piece) OVER x AS p1, lag(piece, 2) OVER x AS p2, lag(start) OVER x AS s1 FROM b {x}), by_ AS (SELECT *, coalesce(regexp_matches(p1, '[{LETTERS}]\\z'), false) AS close, coalesce(regexp_matches(p1, '\\A\\s') AND regexp_matches(p2, '[{LETTERS}]\\z') AND piece <> ',', false) AS apart FROM bx WHERE piece IN (',', '?', ';'))"
        return a, "SELECT doc_id, CASE piece WHEN ',' THEN 'PUNCT_LATIN_COMMA' WHEN '?' THEN 'PUNCT_LATIN_QMARK' ELSE 'PUNCT_LATIN_SEMI' END AS rule_id, CASE WHEN close THEN start ELSE s1 END AS start, stop, translate(piece, ',?;', '،؟؛') AS suggestion FROM by_ WHERE close OR apart"
    if name == "space_before_punct":
        return f"{pieces(r'[ \t]+|[^ \t]+', 'ar', 'c')}, cx AS (SELECT *, lead(piece) OVER x AS nx FROM c {x})", "SELECT doc_id, 'PUNCT_SPACE_BEFORE' AS rule_id, start, stop + 1 AS stop, substr(nx, 1, 1) AS suggestion FROM cx WHERE regexp_matches(piece, '\\A[ \\t]') AND regexp_matches(nx, '\\A[،؛؟!.,:]')"
    if name == "tatweel":
        return pieces(f"{STROKE}+|[^{STROKE}]+", "ar", "d"), f"SELECT doc_id, 'STYLE_TATWEEL' AS rule_id, start, stop, '' AS suggestion FROM d WHERE regexp_matches(piece, '\\A{STROKE}')"
    if name == "dialect_letters":
        return pieces(f"[{LETTERS}]+|[^{LETTERS}]+", "ar", "e"), "SELECT doc_id, 'DIALECT_LETTERS' AS rule_id, start, stop, translate(piece, 'چگپژ', 'جكبز') AS suggestion FROM e WHERE regexp_matches(piece, '[چگپژ]')"
    rows = [(m, n, "AGREEMENT_NUM_FEM_NOUN", f) for m, f in R.MASCULINE_NUMERALS for n in R.FEMININE_COUNTED]
    rows += [(f, n, "AGREEMENT_NUM_MASC_NOUN", m) for m, f in R.MASCULINE_NUMERALS for n in R.MASCULINE_COUNTED]
    a = f"{pieces(RUN, 'ar', 'g')}, {lexicon('gl', 'piece, noun, rule_id, suggestion', tuple(rows))}, gx AS (SELECT *, lead(piece) OVER x AS gap, lead(piece, 2) OVER x AS noun FROM g {x})"
    return a, "SELECT doc_id, rule_id, start, stop, suggestion FROM gx JOIN gl USING (piece, noun) WHERE regexp_matches(gap, '\\A\\s+\\z')"


def check(name: str) -> str:
    a, b = check_parts(name)
    return sql(arabic(), a, b)


def check_pipeline() -> str:
    from warraq.operators.checks import CHECKS

    parts = [check_parts(n) for n in CHECKS]
    built = " UNION ALL ".join(f"SELECT doc_id, start, stop, rule_id, suggestion FROM ({b})" for _, b in parts)
    every = f"m AS (SELECT doc_id, start, stop, rule_id, suggestion, priority, confidence, severity FROM h UNION ALL SELECT doc_id, start, stop, rule_id, suggestion, 0, 0.8, 'warning' FROM ({built}))"
    return sql(arabic(), hits(), *[a for a, _ in parts], every, resolved("m"), "SELECT rule_id, count(*)::BIGINT AS n, sum(start)::BIGINT AS starts FROM r GROUP BY ALL")


def readability(select: str) -> str:
    return sql(
        tokens(), words(),
        "wb AS (SELECT *, lag(form) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM w)",
        "n AS (SELECT doc_id, count(*) AS words, sum(length(form)) AS chars, count(*) FILTER (length(form) >= 8) AS long_words, count(*) FILTER (form = before) AS repeats FROM wb GROUP BY doc_id)",
        sentences(), "sn AS (SELECT doc_id, count(*) AS k FROM sp GROUP BY doc_id)",
        "c AS (SELECT doc_id, greatest(1, coalesce(k, 0))::BIGINT AS sentences, coalesce(words, 0)::BIGINT AS words, coalesce(chars, 0) AS chars, coalesce(long_words, 0) AS long_words, coalesce(repeats, 0) AS repeats FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN sn USING (doc_id))",
        "d AS (SELECT *, words / sentences AS aw, coalesce(chars / nullif(words, 0), 0)::DOUBLE AS ac, coalesce(long_words / nullif(words, 0), 0)::DOUBLE AS lr, (repeats / greatest(1, words - 1))::DOUBLE AS rr FROM c)",
        "e AS (SELECT *, CASE WHEN words = 0 THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0 - (greatest(0.0::DOUBLE, aw - 14.0) * 1.35::DOUBLE + greatest(0.0::DOUBLE, ac - 5.5) * 4.0::DOUBLE + lr * 22.0::DOUBLE + rr * 35.0::DOUBLE))) END AS cl FROM d)",
        "f AS (SELECT doc_id, words, sentences, round(aw, 6)::DOUBLE AS avg_words, round(ac, 6)::DOUBLE AS avg_chars, round(lr, 6) AS long_ratio, round(rr, 6) AS repeated_ratio, round(cl, 6)::DOUBLE AS clarity, CASE WHEN cl >= 82 THEN 'clear' WHEN cl >= 65 THEN 'moderate' WHEN cl >= 45 THEN 'dense' ELSE 'very_dense' END AS band FROM e)",
        select,
    )


#: Sums and moments of the style features by source.
PROFILE = (
    "v AS (SELECT doc_id, source, unnest(['word_length', 'number_share', 'mark_share', 'comma_share']) AS feature, unnest([round(chars * 1000000 / words)::BIGINT, round(numbers * 1000000 / words)::BIGINT, round(marks * 1000000 / words)::BIGINT, round(commas * 1000000 / words)::BIGINT]) AS value FROM p WHERE words > 0), "
    "pr AS (SELECT source, feature, count(*)::BIGINT AS n, sum(value)::HUGEINT AS s, sum(value::HUGEINT * value)::HUGEINT AS q, (s::DOUBLE / 1e6) / n AS mean, CASE WHEN count(*) > 1 THEN sqrt(greatest(0.0::DOUBLE, q::DOUBLE / 1e12 - (s::DOUBLE / 1e6) * (s::DOUBLE / 1e6) / n) / (n - 1)) ELSE 0.0 END AS std FROM v GROUP BY source, feature)"
)


def fingerprint(*parts: str) -> str:
    word = "kind IN ('arabic', 'latin')"
    p = f"p AS (SELECT doc_id, source, count(*) FILTER ({word})::BIGINT AS words, coalesce(sum(length(piece)) FILTER ({word}), 0)::BIGINT AS chars, coalesce(sum(length(piece) * length(piece)) FILTER ({word}), 0)::BIGINT AS chars_sq, count(*) FILTER (kind = 'number')::BIGINT AS numbers, count(*) FILTER (kind = 'punctuation')::BIGINT AS marks, count(*) FILTER (starts_with(piece, '،') OR starts_with(piece, ','))::BIGINT AS commas FROM t GROUP BY doc_id, source)"
    return sql(tokens(), p, *parts)


def dialects() -> str:
    return sql(
        arabic(), tokens("ar"), lexicon("l", "form, dialect, weight", R.DIALECT_FORMS),
        f"a AS (SELECT doc_id, dialect, round(weight / count(*) OVER (PARTITION BY doc_id, start) * 1000)::BIGINT AS w FROM t JOIN l ON form = {normalize('piece', 'lookup')} WHERE kind = 'arabic')",
        "sc AS (SELECT doc_id, dialect, sum(w) / 1000 + 0.08::DOUBLE AS score FROM a GROUP BY ALL)",
        "rk AS (SELECT *, row_number() OVER x AS rank, coalesce(lead(score) OVER x, 0.08::DOUBLE) AS second, sum(score - 0.08::DOUBLE) OVER (PARTITION BY doc_id) AS weight FROM sc WINDOW x AS (PARTITION BY doc_id ORDER BY score DESC, dialect))",
        "rm AS (SELECT ar.doc_id, dialect, score, second, weight, coalesce(score < 0.72 OR (second >= 0.48 AND score - second < 0.3), false) AS ambiguous, least(0.995::DOUBLE, 0.48::DOUBLE + least(0.34::DOUBLE, weight * 0.11::DOUBLE) + least(0.17::DOUBLE, (score - second) * 0.22::DOUBLE)) AS sure FROM ar LEFT JOIN rk ON rk.doc_id = ar.doc_id AND rank = 1)",
        "SELECT doc_id, CASE WHEN ambiguous AND second >= 0.35 THEN 'mixed' ELSE coalesce(dialect, 'msa') END AS dialect, round(coalesce(score, 1.0), 6)::DOUBLE AS score, ambiguous, round(coalesce(CASE WHEN ambiguous THEN least(0.69::DOUBLE, sure) ELSE sure END, 0.995), 5)::DOUBLE AS confidence FROM rm",
    )


def distilled() -> str:
    fixed = "text"
    for bad, good in FIXES:
        fixed = f"replace({fixed}, '{bad}', '{good}')"
    common = lambda x, y: f"len(list_filter(range(1, least(len({x}), len({y})) + 1), lambda i: {x}[1:i] = {y}[1:i]))"
    return sql(
        arabic(), f"o AS (SELECT text AS original, string_split(text, ' ') AS a, string_split({fixed}, ' ') AS b, text <> {fixed} AS changed FROM ar)",
        f"c AS (SELECT *, {common('a', 'b')} AS lead FROM o WHERE changed)",
        f"d AS (SELECT *, least({common('list_reverse(a)', 'list_reverse(b)')}, least(len(a), len(b)) - lead) AS tail FROM c)",
        "e AS (SELECT original, a[lead + 1:len(a) - tail] AS x, b[lead + 1:len(b) - tail] AS y FROM d)",
        "f AS (SELECT array_to_string(x, ' ') AS bad, array_to_string(y, ' ') AS good, count(*)::BIGINT AS support, min(original) AS example FROM e WHERE len(x) BETWEEN 1 AND 3 AND len(y) BETWEEN 1 AND 3 GROUP BY ALL)",
        "SELECT bad, good, support, example, 'DISTILLED_' || upper(left(sha256(bad || chr(9) || good), 10)) AS rule_id FROM f WHERE support >= 3",
    )
