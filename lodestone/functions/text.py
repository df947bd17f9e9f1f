"""Text functions of question answering: normalisation, answer metrics, cleaning and prompt pieces.

All are SQL expressions; none runs Python on the executors. Python's notion of white space and word
characters is written out as explicit classes, since the JVM's short forms differ from it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vectors

#: White space as Python's str.strip and str.split see it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Control tokens that a reflective model writes into its output.
CONTROL_TOKENS = ["[Fully supported]", "[Partially supported]", "[No support / Contradictory]", "[No Retrieval]", "[Retrieval]", "[Irrelevant]", "[Relevant]", "<paragraph>", "</paragraph>", "[Utility:1]", "[Utility:2]", "[Utility:3]", "[Utility:4]", "[Utility:5]", "</s>"]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def split_words(x: Column) -> Column:
    """Words between white space; the empty text has none."""
    return F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "")


def is_clean(x: Column) -> Column:
    """A passage worth keeping: 3 or more characters, ASCII, at most 30 % symbols, not only dots."""
    blank = r"[\s\x1c-\x1f]"
    symbols = F.length(x) - F.length(F.regexp_replace(x, r"[^A-Za-z0-9\s\x1c-\x1f]+", ""))
    few = symbols / F.greatest(F.length(x), F.lit(1)) <= 0.3
    enough = F.regexp_like(x, F.lit(r"[^\s\x1c-\x1f][\s\S]+[^\s\x1c-\x1f]")) & ~F.regexp_like(x, F.lit(rf"^{blank}*+(?:\.\.\.|\. \. \.){blank}*$"))
    # The cheap test first: what fails it needs no replacement.
    return F.coalesce(F.when(F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), False).when(few, enough).otherwise(False), F.lit(False))


def normalize_answer(x: Column) -> Column:
    bare = F.regexp_replace(F.lower(x), PUNCTUATION, "")
    bare = F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.regexp_replace(F.regexp_replace(bare, f"{SPACE}+", " "), "^ | $", "")


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f uses it, as for each entry of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def answer_words(x: Column) -> Column:
    """The normalised words of an answer."""
    return F.filter(F.split(normalize_answer(x), " "), lambda w: w != "")


def _counted(words: Column) -> Column:
    """Each word with how many of it came before, so that a set of these stands for the multiset."""
    return bind(F.array_sort(words), lambda a: F.transform(a, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(a, w)).cast("string"))))


def best_overlap(prediction: Column, golds: Column, words: Callable[[Column], Column]) -> Column:
    """The greatest F1 of the texts' multisets of words over the gold answers; each answer is split once."""
    def f1(p: Column, g: Column) -> Column:
        same = F.size(F.array_intersect(p, g))
        return F.when(same == 0, 0.0).otherwise(2.0 * same / F.greatest(F.size(p) + F.size(g), F.lit(1)))

    return bind(_counted(words(prediction)), lambda p: F.array_max(F.transform(golds, lambda gold: bind(_counted(words(gold)), lambda g: f1(p, g)))))


def best_f1(prediction: Column, golds: Column) -> Column:
    """The greatest token F1 of normalised answers over the gold answers."""
    return best_overlap(prediction, golds, answer_words)


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the normalised answers' token multisets; 0 where they share none."""
    return best_f1(prediction, F.array(gold))


def matches(prediction: Column, golds: Column, normalised: bool = True) -> Column:
    """1 if any gold answer occurs in the prediction."""
    form = normalize_answer if normalised else (lambda x: x)
    return bind(form(prediction), lambda p: F.exists(golds, lambda g: F.contains(p, form(g)))).cast("int")


def soft_match(prediction: Column, golds: Column, vector: Column, gold_vectors: Column, threshold: float = 0.63) -> tuple[Column, Column]:
    """Whether a gold answer occurs in the prediction or else a gold vector's cosine to the prediction's
    reaches the threshold; and whether the vectors alone decided so."""
    hit = F.coalesce(matches(prediction, golds) == 1, F.lit(False))
    near = F.coalesce(F.array_max(F.transform(gold_vectors, lambda g: F.round(vectors.cosine(vector, g), 6))) >= threshold, F.lit(False))
    return hit | near, ~hit & near


def candidates(reply: Column, n: int = 3) -> Column:
    """Answers that a reply lists: all of a JSON array, or else the first n between commas, stripped."""
    parsed = F.from_json(F.when(F.regexp_like(reply, F.lit(r"^\s*\[[\s\S]*\]\s*$")), reply), "array<string>")
    return F.coalesce(parsed, F.transform(F.slice(F.split(reply, ","), 1, n), strip))


def entity_tags(x: Column) -> Column:
    """Map of entity to tag from 'entity <tag>' runs; a later entity wins. The two expressions are fixed
    values: they define what an entity and a tag are."""
    names = F.regexp_extract_all(x, F.lit(r"(.+?)(?=\s<|$)"), F.lit(1))
    tags = F.regexp_extract_all(x, F.lit("<(.+?)>"), F.lit(1))
    n = F.least(F.size(names), F.size(tags))
    clean = F.transform(F.slice(names, F.lit(1), n), lambda e: F.when(F.contains(e, F.lit("<")), F.split_part(e, F.lit("> "), F.lit(2))).otherwise(e))
    # The first occurrence from the end is the last one.
    pairs = F.reverse(F.arrays_zip(clean.alias("k"), F.slice(tags, F.lit(1), n).alias("v")))
    return pairs


def remove_citations(x: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(x, r" \[\d+", ""), r"\[\d+", "")
    return F.replace(F.replace(bare, F.lit(" |"), F.lit("")), F.lit("]"), F.lit(""))


def first_tokens(x: Column, n: int = 100) -> Column:
    return F.regexp_replace(F.array_join(F.slice(split_words(x), 1, n), " "), f"{PUNCTUATION}+$", "")


def strip_control_tokens(x: Column) -> Column:
    return F.regexp_replace(reduce(lambda c, t: F.replace(c, F.lit(t), F.lit("")), CONTROL_TOKENS, x), "^ ", "")


def fix_spacing(x: Column) -> Column:
    return F.regexp_replace(x, r"(?<=[\p{L}\p{N}_])([.!?])(?=[\p{L}\p{N}_])", "$1 ")


def closed_answer(output: Column, task: Column, choices: Column) -> Column:
    """The last of the choices that occurs in the output; for fever its labels; else the output."""
    found = F.try_element_at(F.filter(F.split(choices, " "), lambda c: F.contains(output, c)), F.lit(-1))
    fever = task == "fever"
    return F.when(fever & F.lower(output).isin("true", "false"), F.lower(output)).when(fever & (output == "SUPPORTS"), "true").when(fever & (output == "REFUTES"), "REFUTES").otherwise(F.coalesce(found, output))


def clean_answer(x: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(x, r"\[.*?\]", ""), "<paragraph>.*?</paragraph>", "")
    return strip(F.regexp_replace(bare, f"{SPACE}+", " "))


def anchors_to_text(x: Column) -> Column:
    return F.regexp_replace(x, '<a href="[^"]*">([^<]+)</a>', "$1")


def paragraphs(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit("(?s)<paragraph>(.*?)</paragraph>"), F.lit(1)), strip)


def question_key(x: Column) -> Column:
    """The text after 'Question: ', up to the next such marker; null without one."""
    return strip(F.get(F.split(x, "Question: "), F.lit(1)))


def evidence_block(titles: Column, texts: Column, n: int) -> Column:
    docs = F.slice(F.arrays_zip(titles.alias("title"), texts.alias("text")), 1, n)
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d["title"], F.lit("\n"), d["text"])), "\n")


def arc_choices(labels: Column, texts: Column) -> Column:
    """'A: .. B: ..' block; digits stand for letters, the last text of a letter wins, D may be missing."""
    letter = lambda x: F.when(x.isin("1", "2", "3", "4"), F.translate(x, "1234", "ABCD")).otherwise(x)
    pairs = F.arrays_zip(labels.alias("k"), texts.alias("v"))
    pick = lambda want: F.try_element_at(F.filter(pairs, lambda p: letter(p["k"]) == want), F.lit(-1))["v"]
    block = F.concat(F.lit("\nA: "), pick("A"), F.lit("\nB: "), pick("B"), F.lit("\nC: "), pick("C"), F.lit("\nD: "), F.coalesce(pick("D"), F.lit("")))
    return F.concat(block, F.coalesce(F.concat(F.lit("\nE: "), F.try_element_at(F.filter(pairs, lambda p: p["k"] == "E"), F.lit(-1))["v"]), F.lit("")))


def chat_answer(x: Column) -> Column:
    """What follows the first '[/INST]', up to the next, in single spaces; null without one."""
    return strip(F.regexp_replace(F.get(F.split(x, r"\[/INST\]"), F.lit(1)), f"{SPACE}+", " "))


def titled_documents(titles: Column, texts: Column) -> Column:
    """Lines 'Document [i](Title: t): text'."""
    docs = F.arrays_zip(titles.alias("title"), texts.alias("text"))
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Document ["), (i + 1).cast("string"), F.lit("](Title: "), d["title"], F.lit("): "), d["text"])), "\n")


def plain_documents(texts: Column) -> Column:
    """Lines 'Document [i]: text'."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("Document ["), (i + 1).cast("string"), F.lit("]: "), t)), "\n")


def instruction(task: Column, question: Column, before: dict[str, str], between: dict[str, str]) -> Column:
    """The task's text, what stands between, and the question; the question alone for other tasks."""
    lookup = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[task]
    return F.coalesce(F.concat(lookup(before), F.coalesce(lookup(between), F.lit("")), question), question)


def model_input(task: Column, item: dict[str, Column], before: dict[str, str]) -> tuple[Column, Column]:
    """instruction and golds by task: 'factscore' takes input, and output or else the topic; 'qa' its
    instruction or else the question, and its answers or else the output; long-form tasks their text first."""
    long_form = F.concat(F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[task], F.lit("## Input:\n\n"), item["question"])
    asks = F.when(task == "factscore", item["input"]).when(task == "qa", F.coalesce(item["instruction"], item["question"])).otherwise(long_form)
    golds = F.when(task == "factscore", F.array(F.coalesce(item["output"], item["topic"]))).otherwise(F.coalesce(item["answers"], F.array(item["output"])))
    return asks, golds
