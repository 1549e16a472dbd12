"""Annotation of cells: alternatives, tokens, lemmas, tags; one expression, no Python per row.

The annotator is a plain one (a dictionary of lemmas, suffix rules, a closed-class list) behind the same output as any
other would have: pass `lemmas` to use a dictionary, or replace annotate() where a tagger is at hand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternloom.functions.scalar import applied, quoted, tokens

#: Grouped tags of content words.
CONTENT_TAGS = ("NN", "VB", "JJ", "RB", "IN", "CD")
#: Closed-class words and their grouped tags.
CLOSED = {
    "DT": "a an the this that these those some any each every no".split(),
    "CC": "and or but nor".split(),
    "PR": "i you he she it we they him her them us me its their his our my your who which".split(),
    "TO": ["to"],
    "MD": "can could may might must shall should will would".split(),
    "IN": "of in on at by for from with into through during about between under over than as because if while after before".split(),
    "VB": "is are was were be been being has have had do does did".split(),
}
#: Irregular lemmas of the closed list.
IRREGULAR = {"is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have", "does": "do", "did": "do", "an": "a"}
STOP_LEMMAS = ("be", "of")


#: SQL of the annotation. What stands for a word in lower case is l, for a token t, for the dictionary m.
_TAGS = ", ".join(f"{quoted(w)}, {quoted(t)}" for t, words in CLOSED.items() for w in words)
_TAG = rf"""coalesce(element_at(map({_TAGS}), l), CASE WHEN l RLIKE '^[0-9][0-9.,/%-]*$' THEN 'CD' WHEN NOT l RLIKE r'[a-z0-9\x80-\x{{10FFFF}}]' THEN 'SY' WHEN endswith(l, 'ly') THEN 'RB'
  WHEN l RLIKE '^.{{3,}}(ing|ed|ise|ize|ify)$' THEN 'VB' WHEN l RLIKE '^.{{3,}}(ous|ful|able|ible|ive|less|ish)$' THEN 'JJ' ELSE 'NN' END)"""
_IRREGULAR = ", ".join(f"{quoted(w)}, {quoted(x)}" for w, x in IRREGULAR.items())
_RULES = rf"""coalesce(element_at(map({_IRREGULAR}), l), CASE WHEN l RLIKE '^.{{2,}}ies$' THEN regexp_replace(l, 'ies$', 'y') WHEN l RLIKE '^.{{2,}}(ss|us|is)$' THEN l
  WHEN l RLIKE '^.+(ches|shes|xes|sses|zes)$' THEN regexp_replace(l, 'es$', '') WHEN l RLIKE '^.{{2,}}s$' THEN regexp_replace(l, 's$', '')
  WHEN l RLIKE r'^.{{2,}}([bdfgmnprt])\1(ing|ed)$' THEN regexp_replace(l, '(.)(ing|ed)$', '') WHEN l RLIKE '^.{{3,}}ied$' THEN regexp_replace(l, 'ied$', 'y')
  WHEN l RLIKE '^.{{3,}}ing$' THEN regexp_replace(l, 'ing$', '') WHEN l RLIKE '^.{{3,}}ed$' THEN regexp_replace(l, 'ed$', '') ELSE l END)"""
_LEMMA = {False: _RULES, True: f"coalesce(nullif(try_element_at(m, l), l), {_RULES})"}
_of = lambda sql, name: re.sub(r"\bl\b(?!')", name, sql)
#: A token from its word, in two steps, so that a word is looked up and tagged once.
_KNOWN = {k: f"named_struct('word', w, 'lower', lower(w), 'lemma', {_of(sql, 'lower(w)')}, 'tag', {_of(_TAG, 'lower(w)')})" for k, sql in _LEMMA.items()}
_TOKEN = "named_struct('word', t.word, 'lower', t.lower, 'lemma', t.lemma, 'tword', concat_ws('_', t.word, t.tag), 'tlemma', concat_ws('_', t.lemma, t.tag), 'tag', t.tag, 'postag', concat('pos:', lower(t.tag)))"
_CONTENT = f"t.tag IN ({', '.join(map(quoted, CONTENT_TAGS))})"
_SLOT = "array_distinct(array(t.word, t.lower, t.lemma, t.tword, t.tlemma, t.tag, t.postag))"
_VALUE = "array_distinct(array(t.word, t.lemma))"


def _with(body: str, column: Column, lemmas: Column | None) -> Column:
    """A SQL expression of x, and of the dictionary m where there is one."""
    return applied(f"x -> {body}", column) if lemmas is None else applied(f"(x, m) -> {body}", column, lemmas)


def tag(lower: Column) -> Column:
    """The grouped tag: two letters of the part of speech."""
    return applied(f"l -> {_TAG}", lower)


def lemma(lower: Column, dictionary: Column | None = None) -> Column:
    """Dictionary first; where it has nothing or the word itself, the suffix rules."""
    own = applied(f"l -> {_RULES}", lower)
    return F.coalesce(F.nullif(dictionary, lower), own) if dictionary is not None else own


def token(word: Column, lemmas: Column | None = None) -> Column:
    return _with(f"element_at(transform(transform(array(x), w -> {_KNOWN[lemmas is not None]}), t -> {_TOKEN}), 1)", word, lemmas)


def _annotation(dictionary: bool, content_only: bool) -> str:
    """SQL of a cell's alternatives, each an array of tokens."""
    parts = "transform(split(coalesce(x, ''), ';'), a -> trim(a))"
    alternatives = f"element_at(transform(array({parts}), ps -> concat(ps, transform(filter(ps, a -> contains(a, '-')), a -> replace(a, '-', ' ')))), 1)"
    words = f"transform(filter(split(trim(a), ' +'), w -> w <> ''), w -> {_KNOWN[dictionary]})"
    kept = f"filter({words}, t -> {_CONTENT})" if content_only else words
    return f"array_distinct(transform({alternatives}, a -> transform({kept}, t -> {_TOKEN})))"


def annotate(text: Column, lemmas: Column | None = None, content_only: bool = True) -> Column:
    """ARRAY of alternatives, each an ARRAY of tokens; an empty cell has the one alternative without tokens."""
    return _with(_annotation(lemmas is not None, content_only), text, lemmas)


def alternatives_of(text: Column, lemmas: Column | None = None, content_only: bool = True) -> Column:
    """ARRAY of alternatives, each with its slots (what literals are compared with) and its value (what variables take)."""
    each = f"named_struct('slots', transform(ts, t -> {_SLOT}), 'value', transform(ts, t -> {_VALUE}))"
    return _with(f"transform({_annotation(lemmas is not None, content_only)}, ts -> {each})", text, lemmas)


#: What a pair of neighbouring tags adds to a sentence's score; any other pair adds nothing.
FOLLOWS = {
    "TO VB": 4, "MD VB": 4, "PR VB": 2, "PR NN": -1, "DT NN": 2, "DT JJ": 1, "DT VB": -4, "DT RB": -1, "JJ NN": 2, "JJ VB": -2, "CD NN": 2, "CD VB": -2, "IN NN": 1, "IN VB": -2,
    "NN VB": 1, "NN JJ": -1, "NN NN": 1, "VB NN": 1, "VB DT": 1, "VB VB": -3, "VB JJ": -1, "RB VB": 1, "RB JJ": 1, "RB NN": -1, "MD NN": -2, "TO NN": 1,
}
#: Tags that any word outside the closed classes may have, and what another one than its ending's costs.
OPEN_TAGS, UNLIKELY = ("NN", "VB", "JJ", "RB"), -2
_FOLLOWS = ", ".join(f"{quoted(k)}, {v}" for k, v in FOLLOWS.items())
_MAY_BE = f"""element_at(transform(array({_TAG}), g -> if(element_at(map({_TAGS}), l) IS NOT NULL OR g NOT IN ({", ".join(map(quoted, OPEN_TAGS))}), array(named_struct('tag', g, 'gain', 0)),
  transform(array({", ".join(map(quoted, OPEN_TAGS))}), o -> named_struct('tag', o, 'gain', if(o = g, 0, {UNLIKELY}))))), 1)"""
_PATHS = "array<struct<score:int,path:array<string>>>"
_STEP = f"""transform(c, o -> element_at(transform(array(array_max(transform(b, p -> named_struct('score', p.score + o.gain + coalesce(element_at(map({_FOLLOWS}), concat_ws(' ', element_at(p.path, -1), o.tag)), 0), 'path', p.path)))),
  x -> named_struct('score', x.score, 'path', concat(x.path, array(o.tag)))), 1))"""
_FIRST = "transform(c, o -> named_struct('score', o.gain, 'path', array(o.tag)))"
#: The best path over an array of words in lower case: for each tag of a word the best path up to it is kept.
_DECODED = f"coalesce(array_max(aggregate(transform(ls, l -> {_MAY_BE}), cast(array() AS {_PATHS}), (b, c) -> if(size(b) = 0, {_FIRST}, {_STEP}))).path, cast(array() AS array<string>))"


def sentence_tags(lower: Column) -> Column:
    """The tags of a sentence's words (in lower case): those of the best path, whose score adds up what each word's tag and each
    pair of neighbours gain; of equal scores the last path in ASCII."""
    return applied(f"ls -> {_DECODED}", lower)


def row_alternatives_of(texts: list[Column], wanted: list[int], lemmas: Column | None = None, content_only: bool = True) -> list[Column]:
    """alternatives_of() for the wanted ones of a row's cells, tagged as parts of the sentence that the row is.

    A cell's alternative is read between the first alternatives of the cells before and behind it, so a row is read once for each
    alternative, not for each combination.
    """
    cut = "transform(split(coalesce(x, ''), ';'), a -> trim(a))"
    spread = f"element_at(transform(array({cut}), ps -> concat(ps, transform(filter(ps, a -> contains(a, '-')), a -> replace(a, '-', ' ')))), 1)"
    words = f"transform({spread}, a -> filter(split(trim(a), ' +'), w -> w <> ''))"
    cells = F.call_function("transform", F.array(*texts), F.expr(f"x -> {words}"))  # cells, alternatives, words
    known = f"named_struct('word', w, 'lower', lower(w), 'lemma', {_of(_LEMMA[lemmas is not None], 'lower(w)')}, 'tag', element_at(gs, i + 1))"
    out = []
    for k in wanted:
        before, behind = f"flatten(transform(slice(cs, 1, {k}), c -> c[0]))", f"flatten(transform(slice(cs, {k + 2}, size(cs)), c -> c[0]))"
        tags = f"slice({_DECODED.replace('transform(ls,', 'transform(transform(concat(f, a, b), w -> lower(w)),')}, size(f) + 1, size(a))"
        tokens_ = f"element_at(transform(array({tags}), gs -> transform(a, (w, i) -> {known})), 1)"
        kept = f"filter({tokens_}, t -> {_CONTENT})" if content_only else tokens_
        made = f"array_distinct(transform(cs[{k}], a -> transform({kept}, t -> {_TOKEN})))"
        around = f"element_at(zip_with(array({before}), array({behind}), (f, b) -> {made}), 1)"
        each = f"transform({around}, ts -> named_struct('slots', transform(ts, t -> {_SLOT}), 'value', transform(ts, t -> {_VALUE})))"
        out.append(applied(f"cs -> {each}", cells) if lemmas is None else applied(f"(cs, m) -> {each}", cells, lemmas))
    return out


def omni_slots(toks: Column) -> Column:
    """For each token the set of its representations, which literals are compared with."""
    return F.call_function("transform", toks, F.expr(f"t -> {_SLOT}"))


def omni_value(toks: Column) -> Column:
    """For each token its word and lemma: the value that a variable takes."""
    return F.call_function("transform", toks, F.expr(f"t -> {_VALUE}"))


def namings(text: Column, lemmas: Column | None = None) -> Column:
    """How a cell's first alternative may be named: by its words in lower case, or by the lemmas of its content words."""
    toks = F.element_at(annotate(text, lemmas, content_only=False), 1)
    joined = lambda ts, part: F.array_join(F.transform(ts, lambda t: t[part]), " ")
    return F.filter(F.array_distinct(F.array(joined(toks, "lower"), joined(F.filter(toks, lambda t: t["tag"].isin(*CONTENT_TAGS)), "lemma"))), lambda x: x != "")


def question_tokens(stem: Column, answer: Column, lemmas: Column | None = None) -> Column:
    """The set of words and lemmas, as written and in the dictionary, of the content words of a question and its answer."""
    words = tokens(F.concat_ws(" ", stem, answer))
    content = F.filter(F.transform(words, lambda w: token(w)), lambda t: t["tag"].isin(*CONTENT_TAGS))
    own = F.flatten(F.transform(content, lambda t: F.array(t["word"], t["lemma"])))
    return F.array_distinct(F.flatten(F.transform(own, lambda w: F.array(w, _known(w, lemmas)))))


def row_tokens(text: Column, lemmas: Column | None = None) -> Column:
    """The set of a row's words, each with its dictionary lemma."""
    return F.array_distinct(F.flatten(F.transform(tokens(text), lambda w: F.array(w, _known(w, lemmas)))))


def _known(word: Column, lemmas: Column | None) -> Column:
    return word if lemmas is None else F.coalesce(F.try_element_at(lemmas, F.lower(word)), word)


def content_lemmas(alts: Column) -> Column:
    """All alternatives' lemmas as one set, without stop words."""
    return F.filter(F.array_distinct(F.flatten(F.transform(alts, lambda ts: F.transform(ts, lambda t: t["lemma"])))), lambda x: ~x.isin(*STOP_LEMMAS))


def literal_spans(slots: Column, words: list[str]) -> Column:
    """Starts of all places where the literal's words stand one after another."""
    k = len(words)
    at = lambda s: [F.array_contains(F.element_at(slots, s + i + 1), words[i].lower()) for i in range(k)]
    every = lambda s: at(s)[0] if k == 1 else F.forall(F.array(*at(s)), lambda x: x)
    return F.when(F.size(slots) >= k, F.filter(F.sequence(F.lit(0), F.size(slots) - k), every)).otherwise(F.array().cast("array<int>"))


def relaxed_spans(slots: Column, words: list[str]) -> Column:
    """(start, until) from each start to the first place by which all the literal's words were seen, in any order."""
    want = F.array(*(F.lit(w) for w in dict.fromkeys(w.lower() for w in words)))
    step = lambda a, i: F.when(F.size(a["left"]) == 0, a).otherwise(
        F.struct(F.array_except(a["left"], F.element_at(slots, i + 1)).alias("left"), (i + 1).alias("until"))
    )
    start = lambda s: F.struct(want.alias("left"), s.alias("until"))
    run = lambda s: F.aggregate(F.sequence(s, F.size(slots) - 1), start(s), step)
    spans = F.transform(F.sequence(F.lit(0), F.size(slots) - 1), lambda s: F.struct(s.alias("start"), F.when(F.size(run(s)["left"]) == 0, run(s)["until"]).alias("until")))
    return F.when(F.size(slots) > 0, F.filter(spans, lambda x: x["until"].isNotNull())).otherwise(F.array().cast("array<struct<start:int,until:int>>"))
