"""What a thing is for: tags by its kinds, its name, its description and the boards it stands on, as one expression over a table of rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Boards that say what a model is good at.
REASONING_BOARDS = ("aime_2025", "aime_2026", "gpqa_diamond", "epoch_frontiermath", "epoch_hle", "hle", "arc_agi_1", "arc_agi_2", "arc_agi_3", "epoch_otis_mock_aime", "mmlu_pro")
CODE_BOARDS = (
    "swebench_verified", "swebench_verified_all_agents", "swebench_pro_public", "swebench_multimodal", "livecodebench", "aider_polyglot", "swe_rebench", "terminal_bench_2_0", "terminal_bench_2_1", "lmarena_webdev",
)
AGENT_BOARDS = (
    "bfcl_v4", "tau3_banking", "tau2_bench_overall", "agentbench", "lmarena_agent", "vending_bench_2", "osworld_verified", "webarena", "gaia", "epoch_apex_agents", "epoch_deepresearchbench", "epoch_the_agent_company",
    "epoch_os_world", "epoch_osworld_2", "epoch_blueprint_bench_2", "epoch_forecastbench", "epoch_metr_time_horizons", "epoch_rli", "epoch_btf3", "epoch_vending_bench_2",
)


@dataclass(frozen=True)
class Rule:
    """A tag and what earns it, any of: words in the name, words in name or description, a kind returned, boards. `instead` is what it is called where its words are in name or description.

    `text` rules hold only for what returns text or code; `takes` and `bars` are kinds that are needed among those taken, and barred among those returned.
    """

    tag: str
    named: tuple[str, ...] = ()
    said: tuple[str, ...] = ()
    returns: str = ""
    exactly: bool = False
    boards: tuple[str, ...] = ()
    text: bool = True
    takes: str = ""
    bars: str = ""
    instead: tuple[str, tuple[str, ...]] = ("", ())


# The rules in their order, which is the order of a thing's tags.
RULES = (
    Rule("embedding", named=("embedding", "embed"), returns="embedding", exactly=True, text=False, instead=("rerank", ("rerank",))),
    Rule("rerank", named=("rerank",), text=False),
    Rule("transcribe", said=("transcri", "speech-to-text", "speech to text", "asr", "diariz", "subtitl"), takes="audio", text=False),
    Rule("speak", returns="audio", bars="video", text=False, instead=("music", ("music", "song", "soundtrack", "compose"))),
    Rule("image", returns="image", text=False),
    Rule("video", returns="video", text=False, instead=("avatar", ("avatar", "lip-sync", "lipsync", "talking head"))),
    Rule("ocr", said=("ocr", "document understanding", "reads documents")),
    Rule("code", named=("code", "coder", "codex", "devstral", "starcoder"), returns="code"),
    Rule("translate", said=("translat",)),
    Rule("guard", said=("guardrail", "moderation", "safety classifier", "content safety", "shieldgemma", "llama guard")),
    Rule("search", said=("web search", "search the web", "grounding", "deep research", "retrieval-augmented")),
    Rule("crawl", said=("crawl", "scrape", "render the page", "page render", "browser session", "sitemap")),
    Rule("extract", said=("extract", "parse", "structured output from", "spellcheck", "autosuggest", "answers")),
    Rule("sandbox", said=("sandbox", "code execution", "run code", "code interpreter")),
    Rule("evaluate", said=("evaluat", "trace", "observability", "llm-as-a-judge")),
    Rule("reasoning", named=("thinking", "reasoning", "reasoner"), boards=REASONING_BOARDS),
    Rule("code", boards=CODE_BOARDS),
    Rule("agents", boards=AGENT_BOARDS),
)
#: Tags that take others away, and the one that stands where there is none, for what returns text and is one of these registers.
TAKES_AWAY, PLAIN, ANSWERS = {"ocr": "image"}, "chat", ("model", "agent")


def task_tags(name: Column, said: Column, takes: Column, returns: Column, register: Column, boards: Column) -> Column:
    """A thing's tags, each once, in the rules' order. name and said (its description) are read in lower case, boards is an array; nulls say nothing.

    What takes nothing but audio and returns text transcribes even if nobody says so.
    """
    nothing = lambda c: F.coalesce(c, F.lit(""))
    low, takes, returns, boards = F.lower(nothing(name)), nothing(takes), nothing(returns), F.coalesce(boards, F.array().cast("array<string>"))
    both = F.concat(low, F.lit(" "), F.lower(nothing(said)))
    within = lambda c, words: reduce(Column.__or__, (c.contains(w) for w in words), F.lit(False))
    prose = returns.contains("text") | returns.contains("code")

    def earned(r: Rule) -> Column:
        any_of = within(low, r.named) | within(both, r.said)
        if r.returns:
            any_of = any_of | (returns == r.returns if r.exactly else returns.contains(r.returns))
        if r.boards:
            any_of = any_of | F.arrays_overlap(boards, F.array(*map(F.lit, r.boards)))
        if r.takes:
            any_of = takes.contains(r.takes) & returns.contains("text") & (any_of | (takes == r.takes))
        if r.bars:
            any_of = any_of & ~returns.contains(r.bars)
        return any_of & prose if r.text else any_of

    def called(r: Rule) -> Column:
        other, words = r.instead
        return F.when(within(both, words), other).otherwise(r.tag) if other else F.lit(r.tag)

    tags = F.array_distinct(F.array_compact(F.array(*(F.when(earned(r), called(r)) for r in RULES))))
    for tag, loser in TAKES_AWAY.items():
        tags = F.when(F.array_contains(tags, tag), F.array_remove(tags, loser)).otherwise(tags)
    plain = (F.size(tags) == 0) & prose & register.isin(*ANSWERS)
    return F.when(plain, F.array(F.lit(PLAIN))).otherwise(tags)


def tag_entities(entities: DataFrame, docs: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(id, tags) of things that earn any; of several descriptions the first (by seq) is read."""
    said = docs.where("kind = 'description'").groupBy(F.col("subject").alias("id")).agg(F.min(F.struct("seq", "text")).getField("text").alias("_said"))
    boards = benchmarks.groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("suite").alias("_boards"))
    rows = entities.select("id", "name", "input_kind", "output_kind", "register").join(said, "id", "left").join(boards, "id", "left")
    tags = task_tags(F.col("name"), F.col("_said"), F.col("input_kind"), F.col("output_kind"), F.col("register"), F.col("_boards"))
    return rows.select("id", tags.alias("tags")).where(F.size("tags") > 0)
