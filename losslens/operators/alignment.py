"""Alignment of training examples: messages from the two common layouts, preference transcripts, label masks, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from losslens.functions.text import truncation_budget

IGNORED = -100
MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def none() -> Column:
    return F.array().cast(MESSAGES)


def tagged(answer: Column, good: Column) -> Column:
    """A liked answer stands first with an empty one after it, a disliked one second."""
    empty = F.array(message("assistant", ""))
    return F.when(good, F.concat(answer, empty)).otherwise(F.concat(empty, answer))


def of(rows: DataFrame, columns: dict[str, str], role: str, kind: str = "string") -> Column:
    """The column that has a role, or null of the kind where there is none."""
    return F.col(columns[role]) if columns.get(role) in rows.columns else F.lit(None).cast(kind)


def from_instructions(rows: DataFrame, columns: dict[str, str], ranking: bool = False) -> DataFrame:
    """``prompt``, ``response`` (arrays of role and content), ``system`` and ``tools`` beside the rows' columns.

    ``columns`` names those of prompt, query, response, history (pairs), system,
    tools, kto_tag, chosen and rejected.  Old turns come first, then prompt and
    query on lines of their own.  The response has one answer, or two for a
    liked or disliked answer and for a ranked pair, or none.
    """
    at = lambda role, kind="string": of(rows, columns, role, kind)
    old = F.transform(F.coalesce(at("history", "array<array<string>>"), F.array().cast("array<array<string>>")), lambda p: F.array(message("user", p[0]), message("assistant", p[1])))
    asked = F.concat_ws("\n", F.nullif(at("prompt"), F.lit("")), F.nullif(at("query"), F.lit("")))
    answer, good = F.array(message("assistant", at("response"))), at("kto_tag", "boolean")
    both = F.array(message("assistant", at("chosen")), message("assistant", at("rejected")))
    response = F.when(good.isNotNull(), tagged(answer, good))
    if ranking:
        response = response.when(at("chosen").isNotNull() & at("rejected").isNotNull(), both)
    response = response.when(at("response").isNotNull(), answer).otherwise(none())
    prompt = F.concat(F.flatten(old).cast(MESSAGES), F.array(message("user", asked)).cast(MESSAGES))
    return rows.select("*", prompt.alias("_prompt"), response.cast(MESSAGES).alias("_response"), F.coalesce(at("system"), F.lit("")).alias("_system"), F.coalesce(at("tools"), F.lit("")).alias("_tools"))


#: The tags of speakers, unless a dataset says otherwise.
TAGS = {"user": "human", "assistant": "gpt", "observation": "observation", "function": "function_call", "system": "system"}


def from_turns(rows: DataFrame, columns: dict[str, str], tags: dict[str, str] = TAGS, ranking: bool = False) -> DataFrame:
    """The same from lists of turns (``columns['messages']``: array of role and content).

    A leading system turn becomes the system text.  Turns must be asked
    (user, observation) and answered (assistant, function) in turns, an even
    number of them, odd for ranked pairs; broken examples have empty arrays.
    """
    at = lambda role, kind="string": of(rows, columns, role, kind)
    back = {tag: role for role, tag in tags.items()}
    pair = "struct<role:string,content:string>"
    plain = rows.select("*", F.col(columns["messages"]).cast(MESSAGES).alias("__all"), at("kto_tag", "boolean").alias("__good"), at("chosen", pair).cast(pair).alias("__chosen"), at("rejected", pair).cast(pair).alias("__rejected"))
    leads = F.coalesce(F.get("__all", F.lit(0))["role"] == tags["system"], F.lit(False))
    rest = F.when(leads, F.slice("__all", F.lit(2), F.greatest(F.size("__all") - 1, F.lit(0)))).otherwise(F.col("__all"))
    system = F.when(leads, F.get("__all", F.lit(0))["content"]).otherwise(F.coalesce(at("system"), F.lit("")))
    asks, answers = [tags["user"], tags["observation"]], [tags["assistant"], tags["function"]]
    renamed = lambda m: F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in back.items() for x in kv]), m["role"]).alias("role"), m["content"].alias("content"))
    ready = plain.select("*", rest.alias("__rest"), system.alias("_system"))
    in_turn = F.forall(F.transform("__rest", lambda m, i: F.coalesce(F.when(i % 2 == 0, m["role"].isin(asks)).otherwise(m["role"].isin(answers)), F.lit(False))), lambda ok: ok)
    sound = ready.select("*", (in_turn & (F.size("__rest") % 2 == (1 if ranking else 0))).alias("__sound"), F.transform("__rest", renamed).cast(MESSAGES).alias("__turns"))
    n = F.size("__turns")
    last, before = F.slice("__turns", n, F.least(n, F.lit(1))), F.slice("__turns", F.lit(1), F.greatest(n - 1, F.lit(0)))
    last = F.when(n > 0, last).otherwise(none())
    ranked = F.col("__sound") & F.col("__good").isNull() & F.col("__chosen").isNotNull() & F.col("__rejected").isNotNull() if ranking else F.lit(False)
    response = F.when(~F.col("__sound"), none()).when(F.col("__good").isNotNull(), tagged(last, F.col("__good"))).when(ranked, F.array(renamed(F.col("__chosen")), renamed(F.col("__rejected"))).cast(MESSAGES)).otherwise(last)
    prompt = F.when(~F.col("__sound"), none()).when(ranked, F.col("__turns")).otherwise(before)
    return sound.select(*rows.columns, prompt.alias("_prompt"), response.alias("_response"), "_system", F.coalesce(at("tools"), F.lit("")).alias("_tools"))


def sound_examples(rows: DataFrame, answers: int) -> DataFrame:
    """Examples whose prompt ends with a question and that have so many answers."""
    return rows.where((F.size("_prompt") % 2 == 1) & (F.size("_response") == answers))


def preference_pair(chosen: Column, rejected: Column) -> Column:
    """(instruction, chosen, rejected, history) of two transcripts that differ in their last answer; history is pairs of question and answer."""
    ask, answer = "\n\nHuman: ", "\n\nAssistant: "
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    last = lambda t: bare(F.substring_index(t, answer, -1))
    before = F.substring(chosen, F.lit(1), F.length(chosen) - F.length(F.substring_index(chosen, answer, -1)) - len(answer))
    question = F.substring_index(before, ask, -1)
    earlier = F.substring(before, F.lit(1), F.length(before) - F.length(question) - len(ask))
    turns = F.regexp_extract_all(earlier, F.lit(r"(?s)\n\nHuman: (.*?)\n\nAssistant: (.*?)(?=\n\nHuman: |$)"), F.lit(0))
    part = lambda t, i: bare(F.regexp_extract(t, r"(?s)^\n\nHuman: (.*?)\n\nAssistant: (.*)$", i))
    history = F.transform(turns, lambda t: F.struct(part(t, 1).alias("asked"), part(t, 2).alias("answered")))
    return F.struct(bare(question).alias("instruction"), last(chosen).alias("chosen"), last(rejected).alias("rejected"), history.alias("history"))


def multiturn(pairs: Column, cutoff: int, mask_history: bool = False, train_on_prompt: bool = False, efficient_eos: bool = False, eos: int = 2) -> Column:
    """(input_ids, labels) of turns (an array of source and target ids), cut to ``cutoff`` ids in all.

    Each turn gets what is left of the budget, shared as ``truncation_budget``
    does.  With ``mask_history`` the last turns come first in that, and only the
    last one's target is learned.
    """
    ids, empty = "array<int>", F.array().cast("array<int>")
    ignored = lambda n: F.array_repeat(F.lit(IGNORED), n).cast(ids)
    begin = F.struct(empty.alias("ids"), empty.alias("labels"), F.lit(1 if efficient_eos else 0).cast("long").alias("total"), F.lit(0).alias("turn"))

    def step(have: Column, pair: Column) -> Column:
        source, target = pair["source"].cast(ids), pair["target"].cast(ids)
        room = F.lit(cutoff).cast("long") - have["total"]
        a, b = truncation_budget(F.size(source).cast("long"), F.size(target).cast("long"), room)
        a, b = a.cast("int"), b.cast("int")
        source, target = F.slice(source, F.lit(1), a), F.slice(target, F.lit(1), b)
        if train_on_prompt:
            asked = source
        elif efficient_eos:
            asked = F.concat(F.array(F.lit(eos)), ignored(F.greatest(a - 1, F.lit(0))))
        else:
            asked = ignored(a)
        learned = F.when(F.lit(mask_history) & (have["turn"] != 0), ignored(b)).otherwise(target)
        more, said = F.concat(source, target), F.concat(asked, learned)
        both = (F.concat(more, have["ids"]), F.concat(said, have["labels"])) if mask_history else (F.concat(have["ids"], more), F.concat(have["labels"], said))
        total = have["total"] + a + b
        made = F.struct(both[0].alias("ids"), both[1].alias("labels"), total.cast("long").alias("total"), (have["turn"] + 1).alias("turn"))
        return F.when(have["total"] >= cutoff, have).otherwise(made)

    done = F.aggregate(F.reverse(pairs) if mask_history else pairs, begin, step)
    tail = F.array(F.lit(eos)).cast(ids)
    end = lambda x: F.concat(x, tail) if efficient_eos else x
    return F.get(F.transform(F.array(done), lambda d: F.struct(end(d["ids"]).alias("input_ids"), end(d["labels"]).alias("labels"))), F.lit(0))


def with_other_response(rows: DataFrame, batch: str, order: str, response: str = "_response") -> DataFrame:
    """Rows with ``_kl_response``: the response of the row before in the batch, the last one's for the first."""
    place = Window.partitionBy(batch).orderBy(order)
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("_kl_response", F.coalesce(F.lag(response).over(place), F.last(response).over(whole)))


def answer_of(response: Column) -> tuple[Column, Column]:
    """The answer of a liked or disliked pair, and whether it is the liked one."""
    good = F.coalesce(response[0]["content"], F.lit("")) != ""
    return F.when(good, response[0]["content"]).otherwise(response[1]["content"]), good


def attention_matrix(mask: Column) -> Column:
    """Which places each place may look at: earlier ones and itself of the same sequence; padding (0) looks nowhere."""
    return F.transform(mask, lambda x, i: F.transform(mask, lambda y, j: (x == y) & (y != 0) & (j <= i)))


def masked_sum(scores: Column, labels: Column) -> Column:
    """Sum of the scores whose label counts."""
    return F.aggregate(F.zip_with(scores, labels, lambda s, y: F.when(y != IGNORED, s.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def preference_loss(kind: str, chosen: Column, rejected: Column, chosen_before: Column | None = None, rejected_before: Column | None = None, beta: float = 0.1, smoothing: float = 0.0, gamma: float = 0.5) -> Column:
    """The loss of a pair of log probabilities: sigmoid, hinge and ipo against those of the model before; orpo and simpo without."""
    margin = chosen - rejected
    if kind == "orpo":
        odds = margin - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
        return -chosen - beta * log_sigmoid(odds)
    if kind == "simpo":
        return -log_sigmoid(beta * (margin - gamma / beta))
    gain = margin - (chosen_before - rejected_before)
    if kind == "sigmoid":
        return -log_sigmoid(beta * gain) * (1 - smoothing) - log_sigmoid(-beta * gain) * smoothing
    if kind == "hinge":
        return F.greatest(1 - beta * gain, F.lit(0.0))
    if kind == "ipo":
        return F.pow(gain - 1 / (2 * beta), 2)
    raise ValueError(f"Unknown loss type: {kind}.")


def step_flops(batch: Column, length: Column, hidden: Column, inner: Column, layers: Column, vocabulary: Column, heads: Column, kv_heads: Column, tied: bool = False, backward: bool = True, recompute: bool = False, flash: bool = False) -> Column:
    """Floating-point operations of one training step: projections, attention and embeddings, the backward pass twice the forward."""
    d = lambda c: c.cast("double")
    tokens = d(batch) * d(length)
    mlp = tokens * d(layers) * 6 * d(hidden) * d(inner)
    projections = tokens * d(layers) * (4 * d(hidden) * d(hidden) + 2 * F.floor(2 * d(hidden) * d(hidden) * d(kv_heads) / d(heads)))
    attention = d(batch) * d(layers) * 4 * d(hidden) * d(length) * d(length)
    embedding = tokens * d(hidden) * d(vocabulary) * (1 if tied else 2)
    passes = 3 if backward else 1
    return (passes + (1 if recompute else 0)) * (mlp + projections + attention) + passes * embedding + (attention if flash else 0)
