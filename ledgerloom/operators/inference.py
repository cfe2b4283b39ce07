"""Prompts, fan-out over systems, and models behind one interface, run in batches.

A model is anything with ``generate(prompt) -> str`` and ``loss(prompt, target) -> float``, made once a task by
a factory. Here is a decoder-only transformer in numpy, greedy or sampling among the likeliest tokens, whose weights
come from a checkpoint file, from which its shape is read, or, for tests, from a seed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The systems, and the templates of their prompts.
SYSTEMS = ("baseline_gpt", "rag_gpt_tfidf_top3", "oracle_gpt", "random_context_gpt")
INSTRUCTION = 'Answer using the context. If the context does not contain the answer, say "not enough information."'


def baseline_prompt(q: Column) -> Column:
    return F.concat(F.lit("Question: "), q, F.lit("\nAnswer:"))


def rag_prompt(q: Column, context: Column, candidate: Column) -> Column:
    hint = F.when(F.coalesce(candidate, F.lit("")) != "", F.concat(F.lit("\nCandidate numeric answer from context: "), candidate, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\n"), hint, F.lit("Question: "), q, F.lit(f"\n\n{INSTRUCTION}\nAnswer:"))


def oracle_prompt(q: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Gold evidence:\n"), F.coalesce(evidence, F.lit("")), F.lit("\n\nQuestion: "), q, F.lit("\nAnswer:"))


def random_prompt(q: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), q, F.lit("\nAnswer:"))


def prompts(questions: DataFrame, key: str, context: str, evidence: str, random: str, candidate: str, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """(key, system, prompt): every question for every system; nothing is joined, rows are multiplied in place."""
    q = F.coalesce("question", F.lit(""))
    made = {"baseline_gpt": baseline_prompt(q), "rag_gpt_tfidf_top3": rag_prompt(q, F.col(context), F.col(candidate)), "oracle_gpt": oracle_prompt(q, F.col(evidence)), "random_context_gpt": random_prompt(q, F.col(random))}
    unknown = set(systems) - set(made)
    if unknown:
        raise ValueError(f"unknown systems: {sorted(unknown)}")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), made[s].alias("prompt")) for s in systems)))
    return questions.select(F.col(key), each.alias("_p")).select(key, "_p.system", "_p.prompt")


class LanguageModel(Protocol):
    def generate(self, prompt: str) -> str: ...

    def loss(self, prompt: str, target: str) -> float: ...


# Characters of the small model that shows how models are run; any other is a blank.
CHARACTERS = "\x00 abcdefghijklmnopqrstuvwxyz0123456789.,$%?:-\n"


def demo_model() -> Transformer:
    """A small decoder over characters with drawn weights: it says nothing of sense, but runs as any does, and always alike."""
    place = {c: i for i, c in enumerate(CHARACTERS)}
    return Transformer.random(len(CHARACTERS), 16, 2, 1, 48, seed=7, encode=lambda t: [place.get(c, 1) for c in t.lower()], decode=lambda ids: "".join(CHARACTERS[i] for i in ids), stop=0, most_new=12, temperature=0.8, top_k=5)


def extraction_only(rows: DataFrame, prompt: str, candidate: str, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """Rows with the candidate as ``generated``, its and the prompt's tokens, and no latency: answers that no model makes."""
    count = (lambda t: len(encode(t))) if encode else (lambda t: len(t.split()))

    @F.pandas_udf("int")
    def tokens(t: pd.Series) -> pd.Series:
        return t.fillna("").map(count).astype("int32")

    said = F.coalesce(candidate, F.lit(""))
    return rows.withColumns({"generated": said, "prompt_tokens": tokens(prompt), "completion_tokens": tokens(said), "latency_seconds": F.lit(0.0)})


class Transformer:
    """Pre-norm decoder with learned positions, over token numbers, greedy; attention to the past only."""

    def __init__(self, weights: dict[str, np.ndarray], heads: int, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], stop: int | None = None, most_new: int = 80, temperature: float = 0.0, top_k: int = 0, seed: int = 0):
        """Greedy at temperature 0; else tokens are drawn, among the ``top_k`` likeliest where that is set, alike for the same prompt and seed."""
        self.w, self.heads, self.encode, self.decode, self.stop, self.most_new = weights, heads, encode, decode, stop, most_new
        self.temperature, self.top_k, self.seed = temperature, top_k, seed
        self.room = len(weights["positions"])
        self.blocks = sum(k.endswith(".qkv") for k in weights)

    @classmethod
    def random(cls, vocabulary: int, width: int, heads: int, blocks: int, room: int, seed: int = 0, **kw) -> Transformer:
        r = np.random.default_rng(seed)
        draw = lambda *s: 0.01 * r.standard_normal(s)
        w = {"words": draw(vocabulary, width), "positions": draw(room, width), "out": draw(width, vocabulary), "out_bias": np.zeros(vocabulary)}
        for b in range(blocks):
            w |= {f"{b}.qkv": draw(width, 3 * width), f"{b}.mix": draw(width, width), f"{b}.up": draw(width, 4 * width), f"{b}.up_bias": np.zeros(4 * width), f"{b}.down": draw(4 * width, width), f"{b}.down_bias": np.zeros(width)}
            w |= {f"{b}.{n}": f(width) for n, f in (("norm1", np.ones), ("norm1_bias", np.zeros), ("norm2", np.ones), ("norm2_bias", np.zeros))}
        return cls(w, heads, **kw)

    @classmethod
    def load(cls, path: str, heads: int | None = None, **kw) -> Transformer:
        """A model from a file of named arrays; widths and blocks are read off their shapes, heads from the file or, by default, 64 dimensions each."""
        with np.load(path) as f:
            w = {k: np.asarray(f[k], dtype=np.float64) for k in f.files}
        told = shape_of(w)
        heads = heads or int(w.pop("heads", max(1, told["width"] // 64)))
        if told["width"] % heads:
            raise ValueError(f"{heads} heads do not divide a width of {told['width']}")
        return cls(w, heads, **kw)

    def save(self, path: str) -> None:
        np.savez(path, heads=self.heads, **self.w)

    def _pick(self, z: np.ndarray, rng: np.random.Generator) -> int:
        if self.temperature <= 0:
            return int(z.argmax())
        z = z / self.temperature
        if 0 < self.top_k < len(z):
            z = np.where(z >= np.sort(z)[-self.top_k], z, -np.inf)
        p = np.exp(z - z.max())
        return int(rng.choice(len(z), p=p / p.sum()))

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * self.w[name] + self.w[name + "_bias"]

    def logits(self, ids: list[int]) -> np.ndarray:
        """(positions, vocabulary) of scores of the next token."""
        w, n = self.w, len(ids)
        x = w["words"][ids] + w["positions"][:n]
        future = np.triu(np.full((n, n), -np.inf), 1)
        for b in range(self.blocks):
            q, k, v = (np.stack(np.split(y, self.heads, axis=-1)) for y in np.split(self._norm(x, f"{b}.norm1") @ w[f"{b}.qkv"], 3, axis=-1))
            a = q @ k.transpose(0, 2, 1) / math.sqrt(q.shape[-1]) + future
            a = np.exp(a - a.max(-1, keepdims=True))
            mixed = (a / a.sum(-1, keepdims=True)) @ v
            x = x + np.concatenate(list(mixed), axis=-1) @ w[f"{b}.mix"]
            x = x + np.maximum(self._norm(x, f"{b}.norm2") @ w[f"{b}.up"] + w[f"{b}.up_bias"], 0) @ w[f"{b}.down"] + w[f"{b}.down_bias"]
        return x @ w["out"] + w["out_bias"]

    def generate(self, prompt: str) -> str:
        try:
            rng = np.random.default_rng([self.seed, zlib.crc32(prompt.encode())])
            ids, new = self.encode(prompt)[-self.room :] or [self.stop or 0], []
            while len(new) < self.most_new:
                new.append(self._pick(self.logits((ids + new)[-self.room :])[-1], rng))
                if new[-1] == self.stop:
                    break
            return self.decode(new)
        except Exception as e:  # an answer that can't be made is one, and says so
            return f"[generation error: {e}]"

    def loss(self, prompt: str, target: str) -> float:
        """Mean negative log-likelihood of the target's tokens after the prompt, the latest that fit."""
        before, own = self.encode(prompt), self.encode(target)
        if not own:
            return 0.0
        ids = (before + own)[-self.room :]
        at = np.arange(1, len(ids))[-len(own) :]
        if not len(at):
            return 0.0
        z = self.logits(ids[:-1])[at - 1]
        z = z - z.max(-1, keepdims=True)
        return float((np.log(np.exp(z).sum(-1)) - z[np.arange(len(at)), np.array(ids)[at]]).mean())


def shape_of(w: dict[str, np.ndarray]) -> dict[str, int]:
    """Vocabulary, width, blocks and room of a checkpoint's arrays; an error names what is missing."""
    lacking = [k for k in ("words", "positions", "out", "out_bias") if k not in w]
    blocks = sorted(int(k.split(".")[0]) for k in w if k.endswith(".qkv"))
    if lacking or blocks != list(range(len(blocks))) or not blocks:
        raise ValueError(f"not a checkpoint: {', '.join(lacking) or 'blocks are not numbered from 0'}")
    return {"vocabulary": w["words"].shape[0], "width": w["words"].shape[1], "blocks": len(blocks), "room": w["positions"].shape[0]}


def run_model(rows: DataFrame, factory: Callable[[], LanguageModel], prompt: str, target: str | None = None) -> DataFrame:
    """Rows with ``generated``, and with ``loss`` and ``perplexity`` of a target column; the model is made once a task."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def batches(frames):
        model = factory()
        for f in frames:
            loss = [model.loss(p or "", t or "") for p, t in zip(f[prompt], f[target], strict=True)] if target else [math.nan] * len(f)
            yield f.assign(generated=[model.generate(p or "") for p in f[prompt]], loss=loss, perplexity=[math.exp(min(x, 50.0)) for x in loss])

    return rows.mapInPandas(batches, kept + ", generated string, loss double, perplexity double")


def packed_sequences(docs: DataFrame, order: str, n_tokens: str, room: int = 256) -> DataFrame:
    """(order, first_block, last_block): which blocks of room + 1 tokens each document's tokens fall into, all documents laid end to end.

    The running sum goes over ranges of the order: sums per range first, then within a range.
    """
    from pyspark.sql import Window

    ranged = docs.select(F.col(order).alias("o"), F.col(n_tokens).cast("long").alias("n")).withColumn("part", F.floor(F.col("o") / 100_000))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    at = ranged.join(starts, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return at.select(F.col("o").alias(order), F.floor(F.col("start") / (room + 1)).alias("first_block"), F.floor((F.col("start") + F.greatest(F.col("n") - 1, F.lit(0))) / (room + 1)).alias("last_block"))


