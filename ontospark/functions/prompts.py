"""Prompt, conversation and answer text (P1-P11), and names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the wording of prompts, which answers and training texts depend on
INSTRUCTION = "Given a term, predict its semantic types"
SYSTEM = """You are an expert in ontologies and semantic term classification. Your task is to determine semantic types for given terms based on the domain-specific ontology.

CRITICAL INSTRUCTIONS:
1. Analyze the provided term carefully
2. Determine the most appropriate semantic types from the domain-specific ontology
3. A semantic type is a GENERALIZING CONCEPT or CATEGORY that the term belongs to
4. Use the provided examples to understand the patterns and relationships between terms and their types
5. Respond ONLY in JSON format using \" quotes
6. The reasoning should be concise and to the point, not too long. Write not more than 100 words in reasoning.

RESPONSE FORMAT:
{
  "term": "term name",
  "reasoning": "term name is similar to provided examples, but is not like the first example because ..., so it is not type1, but type2",
  "types": ["type2"]
}

The types should be relevant semantic categories that best describe the given term according to the domain ontology."""
EXAMPLES_HEAD, EXAMPLES_END = "\n\nCLASSIFICATION EXAMPLES:\n", "\nEND OF EXAMPLES.\n"
TASK = (
    "Determine semantic types for the given term based on the domain ontology. Remember that semantic types should be generalizing categories, "
    "not the term itself. Provide reasoning for your choice and respond in JSON format."
)


def instruction(query: Column, task: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def term_text(term: Column, types: Column | None = None) -> Column:
    base = F.concat(F.lit("Term: "), term)
    return base if types is None else F.concat(base, F.lit(", Types: "), F.array_join(types, ", "))


def python_list(items: Column) -> Column:
    """``['a', 'b']``, an item with a single quote in double quotes."""
    q = F.transform(items, lambda x: F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(q, ", "), F.lit("]"))


def few_shot(examples: Column, term: Column, most: int | None = None) -> Column:
    """The user's prompt: numbered examples (structs of term and types, best first), if any, then the term and the task."""
    shots = F.coalesce(examples, F.array().cast("array<struct<term:string,types:array<string>>>"))
    shots = shots if most is None else F.slice(shots, 1, most)
    lines = F.transform(shots, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". Term: '"), F.coalesce(e["term"], F.lit("")), F.lit("' → Types: "), python_list(F.coalesce(e["types"], F.array().cast("array<string>"))), F.lit("\n")))
    block = F.when(F.size(shots) > 0, F.concat(F.lit(EXAMPLES_HEAD), F.array_join(lines, ""), F.lit(EXAMPLES_END))).otherwise("")
    return F.concat(block, F.lit("\nTERM: "), F.coalesce(term, F.lit("")), F.lit(f"\n\nTASK: {TASK}"))


def choose_examples(retrieved: Column, fixed: Column, use_retrieved: bool = True) -> Column:
    """Retrieved examples where asked for and there are any, else the fixed ones."""
    return F.when(F.lit(use_retrieved) & (F.size(F.coalesce(retrieved, F.array())) > 0), retrieved).otherwise(fixed)


def answer_json(reasoning: Column, types: Column) -> Column:
    """The assistant's turn as JSON with a space after each colon and comma."""
    quote = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', "$1")
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(types, F.array().cast("array<string>")), quote), ", "), F.lit("]"))
    return F.concat(F.lit('{"reasoning": '), quote(F.coalesce(reasoning, F.lit(""))), F.lit(', "types": '), listed, F.lit("}"))


def conversation(user: Column, answer: Column | None = None, system: str = SYSTEM) -> Column:
    """Turns of system, user and, for training, assistant."""
    turns = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))]
    if answer is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.array(*turns)


def training_text(term: Column, types: Column, reasoning: Column, examples: Column, most: int | None = None) -> Column:
    """A whole training text: examples, term and answer in the chat template."""
    return chat_template(conversation(few_shot(examples, term, most), answer_json(reasoning, types)))


def chat_template(turns: Column, ask: bool = False) -> Column:
    """Turns in a public chat layout; ``ask`` opens the assistant's turn for a model to go on from."""
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if ask else text


def extract_types(text: Column) -> Column:
    """Types of the first ``{... "types" ...}`` in a text, sorted and distinct; anything else is an empty list."""
    raw = F.from_json(F.regexp_extract(text, r'\{[^}]*"types"[^}]*\}', 0), "types array<string>")["types"]
    return F.array_sort(F.array_distinct(F.coalesce(raw, F.array().cast("array<string>"))))


def step_of(path: Column) -> Column:
    """Number in ``metrics_step_N.json``, else 0."""
    return F.coalesce(F.regexp_extract(path, r"metrics_step_(\d+)\.json$", 1).try_cast("int"), F.lit(0))


def split_of(path: Column) -> Column:
    """The split that the last path part speaks of which speaks of one: train, test or val, in this order within a part."""
    named = F.transform(F.split(F.lower(path), "/"), lambda p: F.when(F.contains(p, F.lit("train")), "train").when(F.contains(p, F.lit("test")), "test").when(F.contains(p, F.lit("val")), "val"))
    return F.coalesce(F.try_element_at(F.array_compact(named), F.lit(-1)), F.lit("unknown"))


def known_part(path: Column, names: list[str]) -> Column:
    return F.coalesce(F.get(F.array_intersect(F.split(path, "/"), F.array(*[F.lit(n) for n in names])), F.lit(0)), F.lit("default"))


def scientific(x: Column) -> Column:
    """``1e-05``: no decimals, an exponent of at least two digits."""
    return F.format_string("%.0e", x)


def run_name(at: Column, dataset: Column, epochs: Column, lr: Column, batch: Column, every: Column, seed: Column, *more: Column) -> Column:
    """``yyyyMMdd_HHmmss_dataset_epE_lrL_bsB_evalV_seedS`` and further parts, null ones left out."""
    part = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), dataset, part("ep", epochs), F.concat(F.lit("lr"), scientific(lr)), part("bs", batch), part("eval", every), part("seed", seed), *more)


def parse_run(name: Column) -> Column:
    """A run name's parameters as a struct: absent ones are null or the default (P24). A leading date and time is skipped, the dataset is
    the part after it; strategies are named ``ds_x`` and ``samp_x``, a freeze strategy ``freeze_x`` with ``rN_aM`` for its ranks."""
    rest = F.regexp_replace(name, r"^\d{8}_\d+_|^\d+_", "")
    get = lambda p: F.nullif(F.regexp_extract(F.concat(F.lit("_"), rest, F.lit("_")), p, 1), F.lit(""))
    return F.struct(
        F.to_timestamp(F.nullif(F.regexp_extract(name, r"^(\d{8}_\d{6})_", 1), F.lit("")), "yyyyMMdd_HHmmss").cast("timestamp_ntz").alias("at"),
        F.nullif(F.regexp_extract(rest, r"^([^_]+)", 1), F.lit("")).alias("dataset"),
        get(r"_ep(\d+)_").try_cast("int").alias("epochs"),
        get(r"_lr([0-9.eE+-]+)_").try_cast("double").alias("lr"),
        get(r"_bs(\d+)_").try_cast("int").alias("batch"),
        get(r"_eval(\d+)_").try_cast("int").alias("every"),
        get(r"_seed(\d+)_").try_cast("int").alias("seed"),
        F.coalesce(get(r"_ds_([a-z]+)_"), F.lit("single")).alias("dataset_strategy"),
        F.coalesce(get(r"_samp_([a-z]+)_"), F.lit("balanced")).alias("sampling_strategy"),
        F.coalesce(get(r"_pos([0-9.]+)_").try_cast("double"), F.lit(1.0)).alias("positive_ratio"),
        get(r"_max(\d+)_").try_cast("int").alias("max_steps"),
        get(r"_freeze_(except_last|[a-z]+)_").alias("freeze"),
        get(r"_r(\d+)_a\d+_").try_cast("int").alias("rank"),
        get(r"_r\d+_a(\d+)_").try_cast("int").alias("alpha"),
        F.coalesce(F.rlike(F.concat(F.lit("_"), rest, F.lit("_")), F.lit("_qwen3_")), F.lit(False)).alias("qwen3"),
    )


def output_name(path: Column, model: Column, domain: Column, shots: Column, retrieved: Column, structured: Column, batch: Column, seed: Column) -> Column:
    """File name of a result (P22): split of the input path, way of choosing examples and their number, domain, model, and what departs
    from the defaults (batch 1, seed 42). ``shots`` null: no examples; 0: of no stated number."""
    amount = lambda name: F.concat(F.lit(name), F.when(shots > 0, F.concat(F.lit("_amount_"), shots.cast("string"))).otherwise(""))
    short = F.replace(F.element_at(F.split(model, "/"), -1), F.lit("-"), F.lit("_"))
    way = F.when(retrieved, amount("rag")).when(shots.isNotNull(), amount("few_shot"))
    odd = lambda c, usual, name: F.when(c != usual, F.concat(F.lit(name), c.cast("string")))
    parts = [F.concat(F.lit("taskB_termtyping_"), split_of(path), F.lit("_results")), way, F.when(domain != "unknown", domain), short, F.when(structured, "structured"), odd(batch, 1, "batch_"), odd(seed, 42, "seed_")]
    return F.concat(F.concat_ws("_", *parts), F.lit(".json"))


def file_suffix(threshold: Column) -> Column:
    """``_threshold_0500`` for 0.5: three decimals without the point."""
    return F.concat(F.lit("_threshold_"), F.replace(F.format_string("%.3f", threshold), F.lit("."), F.lit("")))


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters, as an encoder with a bounded input reads a text."""
    return F.substring(text, 1, most)


def round3(x: Column) -> Column:
    return F.bround(x, 3)
