"""Token counting, sections, chunks under a budget, and what a text's size decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import count_tokens, let, split_lines, strip

#: Costs that a fold takes in one block.
BLOCK = 512

# Fixed values that results depend on: providers in the order they are looked for, those that can be named, and
# keys that stand for none.
PROVIDERS = ("gemini", "anthropic", "mistral", "openrouter", "openai_compatible")
NAMED = ("gemini", "anthropic", "mistral", "openrouter", "openai_compatible", "openai", "ollama", "lm_studio", "vllm")
NO_KEYS = ("your_api_key_here", "your_provider_api_key", "ta_cle_api_gemini", "ta_cle_api", "ta_cle_anthropic")


def sections(text: Column) -> Column:
    """Parts of a text, each from a line that begins with # to the next; stripped, none empty."""
    lines = split_lines(text)
    marked = F.transform(lines, lambda x, i: F.when((i > 0) & x.startswith("#"), F.concat(F.lit("\x00"), x)).otherwise(x))
    parts = F.transform(F.split(F.array_join(marked, "\n"), "\n\x00"), strip)
    return F.filter(parts, lambda s: s != "")


def _cuts(costs: Column, begin: Column, step) -> Column:
    """Places at which `step(state, cost)` begins anew, of a fold over an array of numbers; begin and step give whole numbers.

    step gives (begins, state after). A place is appended to the cuts of its block of some hundred costs, and a block's
    cuts to those before as one value, so no long array is copied for each cost.
    """
    inner, outer = "struct<cuts:array<int>,n:bigint>", "struct<blocks:array<array<int>>,n:bigint>"
    none = F.array().cast("array<int>")

    def one(state: Column, x: Column) -> Column:
        def moved(both: Column) -> Column:
            cuts = F.when(both["begins"], F.array_append(state["cuts"], x["i"])).otherwise(state["cuts"])
            return F.struct(cuts.alias("cuts"), both["n"].cast("bigint").alias("n")).cast(inner)

        begins, after = step(state["n"], x["cost"])
        return let(F.struct(F.coalesce(begins, F.lit(False)).alias("begins"), after.alias("n")), moved)

    def block(placed: Column) -> Column:
        def more(state: Column, b: Column) -> Column:
            part = F.slice(placed, b * BLOCK + 1, F.lit(BLOCK))
            done = F.aggregate(part, F.struct(none.alias("cuts"), state["n"].alias("n")).cast(inner), one)
            return let(done, lambda d: F.struct(F.array_append(state["blocks"], d["cuts"]).alias("blocks"), d["n"].alias("n")).cast(outer))

        start = F.struct(F.array().cast("array<array<int>>").alias("blocks"), begin.cast("bigint").alias("n")).cast(outer)
        blocks = F.sequence(F.lit(0), F.floor((F.size(placed) - 1) / BLOCK).cast("int"))
        return F.when(F.size(placed) == 0, none).otherwise(F.aggregate(blocks, start, more, lambda s: F.flatten(s["blocks"])))

    return let(F.transform(costs, lambda c, i: F.struct(i.alias("i"), c.alias("cost"))), block)


def _joined(parts: Column, cuts: Column, at: Column, j: Column) -> Column:
    """The parts from a cut up to the next, a blank line between them."""
    end = F.coalesce(F.get(cuts, j + 1), F.size(parts))
    return F.array_join(F.slice(parts, at + 1, end - at), "\n\n")


def split_long_section(section: Column, limit: Column) -> Column:
    """Paragraphs of a section joined while the joined text stays within the limit; one that is too long stays whole."""
    paragraphs = F.filter(F.transform(F.split(section, "\n\n"), strip), lambda p: p != "")

    def step(held: Column, chars: Column) -> tuple[Column, Column]:
        joined = held + 2 + chars
        begins = (held < 0) | (F.greatest(F.lit(1), F.floor(joined / 4)) > limit)
        return begins, F.when(begins, chars).otherwise(joined)

    def packed(parts: Column) -> Column:
        cuts = _cuts(F.transform(parts, F.char_length), F.lit(-1), step)
        return let(cuts, lambda places: F.transform(places, lambda at, j: _joined(parts, places, at, j)))

    return let(paragraphs, packed)


def chunk_texts(text: Column, limit: int) -> Column:
    """Chunks of whole sections by the sum of their tokens; a section over the limit is split and joins nothing."""
    most = F.lit(limit)

    def step(held: Column, own: Column) -> tuple[Column, Column]:
        begins = (held < 0) | (held + own > most) | (own > most)
        return begins, F.when(own > most, F.lit(-1)).when(begins, own).otherwise(held + own)

    def packed(parts: Column) -> Column:
        def chunk(places: Column) -> Column:
            def one(at: Column, j: Column) -> Column:
                whole = F.get(parts, at)
                return F.when(count_tokens(whole) > most, split_long_section(whole, most)).otherwise(F.array(_joined(parts, places, at, j)))

            return F.flatten(F.transform(places, one))

        return let(_cuts(F.transform(parts, count_tokens), F.lit(-1), step), chunk)

    return let(sections(text), packed)


def chunked(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """(doc_id, index, text, token_count): a row for each chunk, tokens counted on its body."""
    rows = docs.select("doc_id", F.posexplode(chunk_texts(F.col(text), limit)).alias("index", "text"))
    return rows.withColumn("token_count", count_tokens(F.col("text")))


def route_video(tokens: Column, simple_limit: Column) -> Column:
    return F.when(tokens > simple_limit, "video_dense").otherwise("video_simple")


def route_pdf(tokens: Column, deep_limit: Column, final: Column | None = None) -> Column:
    chosen = F.when(final, "pdf_final_synthesis") if final is not None else F.when(F.lit(False), "")
    return chosen.when(tokens > deep_limit, "pdf_chunk").otherwise("pdf_deep")


def effective_models(models: DataFrame, overrides: DataFrame) -> DataFrame:
    """Models with the id that an override of their name gives them; blank overrides give none."""
    given = overrides.select(F.col("name").alias("__name"), F.nullif(strip(F.col("model")), F.lit("")).alias("__model"))
    joined = models.join(given, F.col("name") == F.col("__name"), "left")
    return joined.withColumn("model", F.coalesce("__model", "model")).drop("__name", "__model")


def choose_provider(keys: DataFrame) -> DataFrame:
    """(setup, provider) of (setup, explicit, provider, key) rows: the explicit one, else the first that has a real key, else the first.

    An explicit provider that isn't known is an error, which comes out as null.
    """
    rank = F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider"))
    key = F.lower(strip(F.coalesce("key", F.lit(""))))
    real = (key != "") & ~key.isin(*NO_KEYS)
    explicit = F.lower(strip(F.col("explicit")))
    # a name's place among the known ones in order, odd if it is one of them: the largest is the largest name's, and
    # numbers are aggregated by hash where texts and structs would be sorted
    names = sorted({"", "auto", *NAMED})
    place = sum(((explicit >= n).cast("int") + (explicit > n).cast("int") for n in names), F.lit(0))
    rows = keys.select("setup", place.alias("__place"), F.when(real & (rank > 0), rank).alias("__rank"))
    found = rows.repartition("setup").groupBy("setup").agg(F.max("__place").alias("__place"), F.min("__rank").alias("__rank"))
    at = F.col("__place")
    unnamed = at.isNull() | at.isin(*(2 * names.index(n) + 1 for n in ("", "auto")))
    named = F.when(at % 2 == 1, F.get(F.array(*map(F.lit, names)), (at / 2).cast("int")))
    first = F.get(F.array(*map(F.lit, PROVIDERS)), (F.coalesce("__rank", F.lit(1)) - 1).cast("int"))
    return found.select("setup", F.when(unnamed, first).otherwise(named).alias("provider"))


def summary_plan(docs: DataFrame, deep_limit: int, chunk_limit: int, text: str = "text") -> DataFrame:
    """(doc_id, step, call, model, prompt_tokens): one call for a text within the limit, else one a chunk and a final one.

    The final call reads the chunks' answers; its size isn't known before they are there.
    """
    sized = docs.withColumn("__n", count_tokens(F.col(text)))
    single = sized.where(F.col("__n") <= deep_limit).select("doc_id", F.lit(0).alias("step"), F.lit("single").alias("call"), F.lit("pdf_deep").alias("model"), F.col("__n").alias("prompt_tokens"))
    parts = chunked(sized.where(F.col("__n") > deep_limit), chunk_limit, text)
    each = parts.select("doc_id", F.col("index").alias("step"), F.lit("chunk").alias("call"), F.lit("pdf_chunk").alias("model"), F.col("token_count").alias("prompt_tokens"))
    last = each.groupBy("doc_id").agg((F.max("step") + 1).alias("step")).select("doc_id", "step", F.lit("final").alias("call"), F.lit("pdf_final_synthesis").alias("model"), F.lit(None).cast("int").alias("prompt_tokens"))
    return single.unionByName(each).unionByName(last)


def instruction_kind(instruction: Column) -> Column:
    """`targeted` where the user asks for something, else `neutral`."""
    return F.when(strip(F.coalesce(instruction, F.lit(""))) != "", "targeted").otherwise("neutral")
