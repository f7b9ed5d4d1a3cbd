"""Common table expressions that restate morphology and syntax in SQL."""

from __future__ import annotations

from warraq.functions import resources as R
from warraq.operators.morphology import template_regex
from warraq.plans import duck as D

FEATURES = "lemma, root, pattern, pos, gender, number, definite, preposition, tense"
NOUNS = "('noun', 'verbal_noun')"


def corpus() -> str:
    s, n = "[" + ", ".join(map(D.quoted, R.GRAMMAR_SENTENCES)) + "]", len(R.GRAMMAR_SENTENCES)
    return f"s0 AS (SELECT {s} AS s), ar AS (SELECT doc_id, lang, source, concat_ws(' ', s[doc_id % {n} + 1], s[(doc_id * 5 + 1) % {n} + 1], s[(doc_id * 11 + 3) % {n} + 1]) AS text FROM documents, s0)"


def listed(xs: tuple) -> str:
    return "(" + ", ".join(map(D.quoted, xs)) + ")"


def forms() -> str:
    sure = "round(0.98 - CASE WHEN prefix <> '' THEN 0.02 ELSE 0 END - CASE WHEN ending <> '' THEN 0.03 ELSE 0 END, 6)::DOUBLE AS confidence, 'lexicon' AS origin"
    return ", ".join((
        D.lexicon("lx", "lemma, root, pattern, pos, gender, frequency", R.LEXEMES), D.lexicon("np", "prefix, definite, preposition", R.NOMINAL_PREFIXES),
        D.lexicon("ne", "ending, number, gender, tail", R.NOMINAL_ENDINGS), D.lexicon("va", "prefix, ending, gender, number, tense", R.VERB_AFFIXES),
        f"fm AS (SELECT prefix || CASE WHEN suffix(lemma, 'ة') THEN left(lemma, length(lemma) - 1) || tail ELSE lemma END || ending AS form, lemma, root, pattern, pos, gender, number, definite, preposition, '' AS tense, frequency, {sure} FROM lx JOIN ne USING (gender) CROSS JOIN np WHERE pos <> 'verb' "
        f"UNION ALL SELECT prefix || lemma || ending, lemma, root, pattern, pos, va.gender, number, false, '', tense, frequency, {sure} FROM lx CROSS JOIN va WHERE pos = 'verb')",
    ))


def analyses(words: str) -> str:
    """``an``: ranked analyses of the column form of ``words``."""
    cost = "CASE WHEN prefix <> '' AND ending <> '' THEN 0.10 WHEN prefix <> '' THEN 0.05 WHEN ending <> '' THEN 0.06 ELSE 0 END"
    return ", ".join((
        forms(), D.lexicon("pf", "prefix", tuple((p,) for p in R.STEM_PREFIXES)), D.lexicon("ef", "ending", tuple((e,) for e in R.STEM_ENDINGS)),
        D.lexicon("tp", "pattern, regex, pos, base", tuple((n, template_regex(n), p, c) for n, p, c in R.TEMPLATES)), f"wd AS ({words})",
        "st AS (SELECT form, prefix, ending, substr(form, length(prefix) + 1, length(form) - length(prefix) - length(ending)) AS stem FROM wd, pf, ef WHERE starts_with(form, prefix) AND suffix(form, ending) AND length(form) - length(prefix) - length(ending) >= 3)",
        "tm AS (SELECT form, prefix, ending, stem, pattern, pos, base, regexp_replace(stem, regex, '\\1\\2\\3') AS root FROM st JOIN tp ON regexp_matches(stem, regex))",
        "kr AS (SELECT root, max(frequency) AS frequency FROM lx GROUP BY root)",
        f"ev AS (SELECT form, {FEATURES}, frequency, confidence, origin FROM fm JOIN wd USING (form) UNION ALL SELECT form, stem, root, pattern, pos, CASE WHEN suffix(stem, 'ة') OR ending = 'ات' THEN 'feminine' ELSE 'masculine' END, "
        "CASE WHEN ending IN ('ات', 'ون') THEN 'plural' WHEN ending = 'ين' THEN 'dual' ELSE 'singular' END, suffix(prefix, 'ال'), CASE WHEN prefix IN ('ب', 'بال') THEN 'ب' WHEN prefix = 'ل' THEN 'ل' ELSE '' END, "
        "CASE WHEN pattern = 'يفعل' THEN 'present' WHEN pos = 'verb' THEN 'past' ELSE '' END, coalesce(frequency, 1), "
        f"round(greatest(0.25, least(0.86, base + CASE WHEN frequency IS NULL THEN 0 ELSE 0.17 END - {cost})), 6)::DOUBLE, 'template' FROM tm LEFT JOIN kr USING (root))",
        f"mg AS (SELECT form, {FEATURES}, max({{'c': confidence, 'f': frequency, 'o': origin}}) AS m FROM ev GROUP BY ALL)",
        f"rk AS (SELECT form, {FEATURES}, m.c AS confidence, m.f AS frequency, m.o AS origin, row_number() OVER x AS rank, lead(m.c) OVER x AS second FROM mg WINDOW x AS (PARTITION BY form ORDER BY m.c DESC, m.f DESC, {FEATURES}))",
        f"an AS (SELECT form, {FEATURES}, frequency::BIGINT AS frequency, confidence, origin, rank, CASE WHEN rank = 1 THEN round(coalesce(confidence - second, 0.3), 6)::DOUBLE END AS margin FROM rk)",
    ))


def relations() -> str:
    """``rel``: the relations of adjacent words of ``ar``."""
    sure = lambda k, *xs: f"round(least(0.999, {k} * 0.55 + 0.45 * least({', '.join(f'coalesce({x}, 0)' for x in xs)})), 6)::DOUBLE"
    near = "r IS NOT NULL AND "
    specs = (
        ("DEMONSTRATIVE", f"{near}form IN {listed(tuple(d for d, _, _ in R.DEMONSTRATIVES))} AND r.pos IN {NOUNS}", "idx", "r.idx", sure(0.98, "r.sure")),
        ("PREPOSITION_OBJECT", f"{near}form IN {listed(R.PREPOSITIONS)} AND r.pos IN ('noun', 'verbal_noun', 'adjective')", "idx", "r.idx", sure(0.97, "r.sure")),
        ("SUBJUNCTIVE_VERB", f"{near}form IN {listed(R.SUBJUNCTIVE_PARTICLES)} AND r.pos = 'verb'", "idx", "r.idx", sure(0.96, "r.sure")),
        ("JUSSIVE_VERB", f"{near}form IN {listed(R.JUSSIVE_PARTICLES)} AND r.pos = 'verb'", "idx", "r.idx", sure(0.97, "r.sure")),
        ("NAAT", f"{near}pos IN {NOUNS} AND r.pos = 'adjective' AND definite AND r.definite", "idx", "r.idx", sure(0.94, "sure", "r.sure")),
        ("IDAFA", f"{near}pos IN {NOUNS} AND r.pos IN {NOUNS} AND NOT definite AND r.definite", "idx", "r.idx", sure(0.91, "sure", "r.sure")),
        ("SUBJECT", f"{near}lemma IN {listed(R.INTRANSITIVE)} AND pos = 'verb' AND r.pos IN {NOUNS}", "idx", "r.idx", sure(0.93, "sure", "r.sure")),
        ("SUBJECT", f"{near}pos IN {NOUNS} AND definite AND r.pos = 'verb'", "r.idx", "idx", sure(0.88, "sure", "r.sure")),
        ("PREPOSITION_OBJECT", f"pos IN {NOUNS} AND preposition <> ''", "NULL::BIGINT", "idx", "round(least(0.97, sure + 0.04), 6)::DOUBLE"),
    )
    fields = ("idx", "start", "stop", "piece", "form", "apart", "lemma", "pos", "gender", "number", "definite", "preposition", "tense", "sure")
    struct = ", ".join(f"'{f}': {f}" for f in fields)
    return ", ".join((
        D.tokens("ar"),
        f"w1 AS (SELECT doc_id, idx, start, stop, piece, kind, {D.normalize('piece', 'lookup')} AS form, sum((kind IN ('punctuation', 'symbol', 'code', 'url', 'email'))::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS apart FROM t)",
        analyses("SELECT DISTINCT form FROM w1 WHERE kind = 'arabic'"),
        "bs AS (SELECT *, round(least(0.999, confidence * 0.82 + least(0.18, margin * 0.6)), 6)::DOUBLE AS sure FROM an WHERE rank = 1 AND confidence >= 0.55)",
        "w2 AS (SELECT * FROM w1 LEFT JOIN bs USING (form) WHERE kind = 'arabic')",
        f"w3 AS (SELECT *, lead({{{struct}}}) OVER (PARTITION BY doc_id ORDER BY idx) AS r0 FROM w2)", "w4 AS (SELECT *, CASE WHEN r0.apart = apart THEN r0 END AS r FROM w3)",
        "rel AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS relation, {h} AS head, {d} AS dependent, {s} AS conf FROM w4 WHERE {w}" for n, w, h, d, s in specs) + ")",
    ))


def checks() -> str:
    demo = {d: (g, next(x for x, g2, far2 in R.DEMONSTRATIVES if far2 == far and g2 != g)) for d, g, far in R.DEMONSTRATIVES}
    gender = "CASE form " + " ".join(f"WHEN '{d}' THEN '{g}'" for d, (g, _) in demo.items()) + " END"
    other = "CASE form " + " ".join(f"WHEN '{d}' THEN '{o}'" for d, (_, o) in demo.items()) + " END"
    cut = lambda c, n: f"left({c}, length({c}) - {n})"
    specs = (
        ("SYNTAX_DEMONSTRATIVE_AGREEMENT", f"relation = 'DEMONSTRATIVE' AND r.number = 'singular' AND {gender} <> r.gender", "start", "r.stop", f"{other} || ' ' || r.piece"),
        ("SYNTAX_NAAT_AGREEMENT", "relation = 'NAAT' AND number = 'singular' AND r.number = 'singular' AND gender <> r.gender", "r.start", "r.stop", f"CASE WHEN suffix(r.piece, 'ة') THEN {cut('r.piece', 1)} ELSE r.piece || 'ة' END"),
        ("SYNTAX_VERB_SUBJECT_GENDER", "relation = 'SUBJECT' AND pos = 'verb' AND tense = 'past' AND r.number = 'singular' AND gender = 'masculine' AND r.gender = 'feminine'", "start", "stop", "piece || 'ت'"),
        ("SYNTAX_PREPOSITION_CASE", "relation = 'PREPOSITION_OBJECT' AND head IS NOT NULL AND r.number <> 'singular' AND (suffix(r.piece, 'ون') OR suffix(r.piece, 'ان'))", "r.start", "r.stop", f"{cut('r.piece', 2)} || 'ين'"),
        ("SYNTAX_FIVE_VERBS", "relation IN ('SUBJUNCTIVE_VERB', 'JUSSIVE_VERB') AND suffix(r.piece, 'ون')", "r.start", "r.stop", f"{cut('r.piece', 1)} || 'ا'"),
        ("SYNTAX_IDAFA_NUN_DROP", "relation = 'IDAFA' AND number <> 'singular' AND (suffix(piece, 'ون') OR suffix(piece, 'ين') OR suffix(piece, 'ان'))", "start", "stop", cut("piece", 1)),
    )
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule_id, {a} AS start, {b} AS stop, {s} AS suggestion FROM rel WHERE conf >= 0.8 AND {w}" for n, w, a, b, s in specs)


def pattern_rules() -> tuple[str, ...]:
    """``pr3``: matches of the rules with patterns, of the profiles formal and academic."""
    every = [r for r in R.PATTERN_RULES if r[3] in ("all", "formal", "academic")]
    cut = lambda name, regex: f"SELECT doc_id, text, '{name}' AS rule_id, string_split_regex(text, {D.quoted(regex)}) AS g, regexp_extract_all(text, {D.quoted(regex)}) AS m FROM ar"
    spans = lambda a, b: f"{b} AS (SELECT doc_id, text, rule_id, m[i] AS surface, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {a}))"
    left, right = "substr(text, greatest(start - 60, 0) + 1, start - greatest(start - 60, 0))", "substr(text, stop + 1, 60)"
    end = "'[.!?؟؛…\\n]'"
    where = {
        "match": "surface", "window": f"{left} || surface || {right}",
        "sentence": f"string_split_regex(substr(text, 1, start), {end})[-1] || surface || string_split_regex(substr(text, stop + 1), {end})[1]",
    }
    tests, to = [], []
    for name, regex, suggestion, _, before, after, exception, scope in every:
        t = [f"regexp_matches({left}, {D.quoted(f'(?:{before}){chr(92)}z')})"] if before else []
        t += [f"regexp_matches({right}, {D.quoted(f'{chr(92)}A(?:{after})')})"] if after else []
        t += [f"NOT regexp_matches({where[scope]}, {D.quoted(exception)})"] if exception else []
        tests.append(f"WHEN '{name}' THEN {' AND '.join(t) or 'true'}")
        to.append(f"WHEN '{name}' THEN regexp_replace(surface, {D.quoted(regex)}, {D.quoted(suggestion.replace('$', chr(92)))}, 'g')")
    blocked = "CASE rule_id " + " ".join(f"WHEN '{n}' THEN '{b}'" for n, _, b in R.EXCEPTION_RULES) + " END"
    return (
        "pr0 AS (" + " UNION ALL ".join(cut(r[0], r[1]) for r in every) + ")", spans("pr0", "pr1"),
        "ex0 AS (" + " UNION ALL ".join(cut(n, p) for n, p, _ in R.EXCEPTION_RULES) + ")", spans("ex0", "ex1"),
        f"ex2 AS (SELECT doc_id, {blocked} AS rule_id, start, start + length(surface) AS stop FROM ex1)", "pr2 AS (SELECT *, start + length(surface) AS stop FROM pr1)",
        f"pr3 AS (SELECT doc_id, rule_id, start, stop, CASE rule_id {' '.join(to)} END AS suggestion FROM pr2 WHERE CASE rule_id {' '.join(tests)} END AND NOT EXISTS (SELECT 1 FROM ex2 WHERE ex2.doc_id = pr2.doc_id AND ex2.rule_id = pr2.rule_id AND ex2.start < pr2.stop AND pr2.start < ex2.stop))",
    )


def light_verbs() -> str:
    rows = tuple((p + a, n, p + dict(zip(("masculine", "feminine", "plural"), v, strict=True))[g]) for a, g in R.AUXILIARIES for p in ("", "و", "ف") for n, *v in R.NOMINALIZATIONS)
    fixed = ", ".join("(" + ", ".join(map(D.quoted, r)) + ")" for r in rows)
    return f"SELECT doc_id, 'STYLE_LIGHT_VERB_NOMINALIZATION' AS rule_id, start, r.stop AS stop, x.verb AS suggestion, round(least(coalesce(sure, 0.85), r.sure) * 0.9, 6)::DOUBLE AS confidence FROM w4 JOIN (VALUES {fixed}) x(aux, noun, verb) ON form = aux AND r.lemma = noun WHERE r.pos = 'verbal_noun' AND r.preposition <> ''"


def sentence_words() -> str:
    """``sw``: Arabic words with the stretch they stand in and their analysis."""
    return ", ".join((
        D.tokens("ar"),
        f"v1 AS (SELECT doc_id, idx, start, stop, piece, kind, {D.normalize('piece', 'lookup')} AS form, sum(((kind = 'punctuation' AND regexp_matches(piece, '[.!?؟؛…]')) OR (kind = 'whitespace' AND contains(piece, chr(10))))::INT) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS sent FROM t)",
        "v2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY idx) AS place FROM v1 WHERE kind = 'arabic')", analyses("SELECT DISTINCT form FROM v2"),
        "bs AS (SELECT *, round(least(0.999, confidence * 0.82 + least(0.18, margin * 0.6)), 6)::DOUBLE AS sure FROM an WHERE rank = 1 AND confidence >= 0.55)",
        "sw AS (SELECT v2.*, lemma, pos, sure FROM v2 LEFT JOIN bs USING (form))",
    ))


def dense_sentences(words: int, nouns: int, links: int) -> str:
    link = f"form IN {listed(R.CONNECTIVES)} OR (length(form) > 2 AND left(form, 1) IN ('و', 'ف'))"
    return (
        f"SELECT doc_id, 'STYLE_NOMINALIZATION_DENSITY' AS rule_id, min(start) AS start, least(max(stop), min(start) + 48) AS stop, count(*)::BIGINT AS words, count(*) FILTER (pos = 'verbal_noun')::BIGINT AS nouns, count(*) FILTER ({link})::BIGINT AS links FROM sw GROUP BY doc_id, sent "
        f"HAVING count(*) >= {words} AND count(*) FILTER (pos = 'verbal_noun') >= {nouns} AND count(*) FILTER (pos = 'verbal_noun') > 2 * count(*) FILTER (pos = 'verb') AND count(*) FILTER ({link}) >= {links}"
    )


def contradictions() -> str:
    """By self-joins, where the operator uses windows."""
    bare = "CASE WHEN length(n.form) > 2 AND left(n.form, 1) IN ('و', 'ف') THEN substr(n.form, 2) ELSE n.form END"
    same = "{0}.doc_id = v.doc_id AND {0}.sent = v.sent"
    return (
        f"SELECT v.doc_id, 'SEMANTIC_EXPLICIT_SELF_CONTRADICTION' AS rule_id, n.start AS start, v.stop AS stop, v.lemma, round(least(0.985, v.sure), 6)::DOUBLE AS confidence FROM sw v JOIN sw n ON {same.format('n')} AND n.place = v.place - 1 AND {bare} IN {listed(R.NEGATORS)} "
        f"JOIN sw p ON {same.format('p')} AND p.place = (SELECT max(q.place) FROM sw q WHERE {same.format('q')} AND q.place < v.place AND q.lemma = v.lemma AND q.pos = 'verb') WHERE v.pos = 'verb' AND n.place - p.place <= 8 "
        f"AND NOT EXISTS (SELECT 1 FROM sw m WHERE {same.format('m')} AND m.place > p.place AND m.place <= v.place AND m.form IN {listed(R.TEMPORAL)})"
    )


def senses(gate: str = "coalesce(sure, 0) < 0.86 OR gap <= 0.08") -> str:
    """``sn``: readings of ambiguous words with their probabilities."""
    at = lambda f, k, c: f"{f}({c}, {k}) OVER x"
    near = ", ".join(f"'{s}{k}:' || {at(f, k, 'form')}, '{s}_pos{k}:' || {at(f, k, 'pos')}" for s, f in (("left", "lag"), ("right", "lead")) for k in (1, 2))
    edges = f"CASE WHEN place = 1 THEN 'bos' END, CASE WHEN {at('lead', 1, 'form')} IS NULL THEN 'eos' END, CASE WHEN starts_with({at('lead', 1, 'form')}, 'ال') THEN 'next_definite' END, 'bias'"
    return ", ".join((
        f"sf AS (SELECT doc_id, idx, form, sure, [{near}, {edges}] AS features FROM sw WINDOW x AS (PARTITION BY doc_id, sent ORDER BY place))",
        "rd AS (SELECT form, pos, lemma, max(confidence) AS confidence FROM an GROUP BY ALL)",
        "re AS (SELECT form, list(confidence ORDER BY confidence DESC) AS cs FROM rd GROUP BY form HAVING count(*) >= 2)",
        D.lexicon("sx", "pos, feature, w", R.SENSE_WEIGHTS),
        f"sa AS (SELECT doc_id, idx, sf.form, pos, lemma, confidence, features FROM (SELECT sf.*, round(cs[1] - cs[2], 6) AS gap FROM sf JOIN re USING (form)) sf JOIN rd USING (form) WHERE {gate})",
        "sb AS (SELECT doc_id, idx, form, sa.pos, lemma, coalesce(sum(round(w * 1000)::BIGINT), 0)::DOUBLE / 1000 + ln(confidence) * 0.08 AS score FROM sa LEFT JOIN sx ON sx.pos = sa.pos AND list_contains(features, feature) GROUP BY doc_id, idx, form, sa.pos, lemma, confidence)",
        "sc AS (SELECT *, exp((score - max(score) OVER (PARTITION BY doc_id, idx)) / 0.82) AS e FROM sb)", "sn AS (SELECT doc_id, idx, form, pos, lemma, round(e / sum(e) OVER (PARTITION BY doc_id, idx), 5)::DOUBLE AS prob FROM sc)",
    ))


def conversions() -> str:
    """``cv``: standard forms of dialect words over the tokens of ``ar``."""
    return ", ".join((
        D.lexicon("ms", "form, suggestion, confidence", R.MSA_FORMS), D.lexicon("ds", "form, want", R.DESIRE_FORMS),
        f"y1 AS (SELECT *, {D.normalize('piece', 'lookup')} AS form FROM t)",
        "y2 AS (SELECT *, lead(kind) OVER x AS gap, lead(form, 2) OVER x AS verb, lead(kind, 2) OVER x AS vk, lead(stop, 2) OVER x AS vs FROM y1 WINDOW x AS (PARTITION BY doc_id ORDER BY idx))",
        "cv AS (SELECT doc_id, start, stop, suggestion, confidence, 'DIALECT_WORD' AS rule_id, 'hint' AS severity, 45 AS priority FROM y2 JOIN ms USING (form) WHERE kind = 'arabic' AND confidence >= 0.76 UNION ALL "
        "SELECT doc_id, start, vs, want || ' أن ' || verb, 0.9, 'DIALECT_DESIRE', 'hint', 60 FROM y2 JOIN ds USING (form) WHERE kind = 'arabic' AND gap = 'whitespace' AND vk = 'arabic' AND length(verb) >= 4 AND left(verb, 1) IN ('ي', 'ت', 'ن', 'أ'))",
    ))


def endings() -> tuple[str, str]:
    case = "CASE m.r WHEN 'DEMONSTRATIVE' THEN 'follows' WHEN 'NAAT' THEN 'follows' WHEN 'IDAFA' THEN 'genitive' WHEN 'PREPOSITION_OBJECT' THEN 'genitive' WHEN 'JUSSIVE_VERB' THEN 'jussive' WHEN 'SUBJECT' THEN 'nominative' ELSE 'subjunctive' END"
    pick = "CASE c " + " ".join(f"WHEN '{c}' THEN CASE WHEN definite THEN '{x}' ELSE '{y}' END" for c, x, y in R.ENDINGS) + " END"
    return (
        f"kc AS (SELECT doc_id, dependent, m.h AS head, {case} AS c FROM (SELECT doc_id, dependent, max({{'c': conf, 'r': relation, 'h': head}}) AS m FROM rel GROUP BY ALL))",
        f"SELECT doc_id, idx, piece, c AS \"case\", bare || {pick} AS marked FROM (SELECT w2.*, regexp_replace(piece, '[{D.MARKS}]+$', '') AS bare, c FROM w2 JOIN "
        "(SELECT k.doc_id, k.dependent, CASE WHEN k.c = 'follows' THEN h.c ELSE k.c END AS c FROM kc k LEFT JOIN kc h ON h.doc_id = k.doc_id AND h.dependent = k.head AND h.c <> 'follows') z ON z.doc_id = w2.doc_id AND z.dependent = w2.idx) q "
        "WHERE number = 'singular' AND c IS NOT NULL AND right(bare, 1) NOT IN ('ا', 'ى', 'ي', 'و')",
    )


def tone_shifts(least: float, share: float) -> str:
    tones = ("assertive", "conversational", "formal", "objective", "persuasive")
    sums = ", ".join(f"coalesce(sum(w) FILTER (tone = '{t}'), 0)::BIGINT AS {t}" for t in tones)
    total = "(1900 + " + " + ".join(tones) + ")"
    ranked = "list_sort([" + ", ".join(f"{{'s': -(180 + {t}), 't': '{t}'}}" for t in tones) + ", {'s': -1000, 't': 'neutral'}])"
    scored = lambda source: f"SELECT *, o[1].t AS top, round(least(0.999, -o[1].s / tt + (-o[1].s / tt + o[2].s / tt) * 0.5), 6)::DOUBLE AS conf FROM (SELECT *, {ranked} AS o, {total} AS tt FROM {source})"
    lex = D.lexicon("tl", "tone, form, w", tuple((t, f, round(w * 1000)) for t, f, w in R.TONE_WORDS))
    return (
        f"SELECT doc_id, 'STYLE_TONE_SHIFT' AS rule_id, start, least(stop, start + 48) AS stop, round(least(conf, dc) * 0.9, 6)::DOUBLE AS confidence FROM (WITH {lex}, se AS (SELECT doc_id, sent, min(start) AS start, max(stop) AS stop, {sums} FROM sw LEFT JOIN tl USING (form) GROUP BY doc_id, sent), "
        f"dd AS ({scored('(SELECT doc_id, ' + ', '.join(f'sum({t})::BIGINT AS {t}' for t in tones) + ' FROM se GROUP BY doc_id)')}), "
        f"s2 AS (SELECT s.*, dd.top AS dt, dd.conf AS dc FROM ({scored('se')}) s JOIN dd USING (doc_id)) SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, count(*) FILTER (top = dt AND conf >= 0.38) OVER (PARTITION BY doc_id) AS k FROM s2) "
        f"WHERE dt IN ('formal', 'objective') AND n >= 3 AND k >= greatest(2, ceil(n * {share})) AND top = 'conversational' AND conf >= {least}"
    )
