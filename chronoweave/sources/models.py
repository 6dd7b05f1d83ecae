"""Language models as a source: prompts in, parsed replies out. Nothing here needs a network unless an HTTP model is used."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTS, REPLIES, TIMEOUT = 8, 7, 240
#: Prompts of the extraction calls; {passage} and {so_far} are filled in.
PROMPTS = {
    "node": "Read the numbered sentences below. Each describes one event. Decide which storyline each event belongs to and give every storyline a short id.\n\n{passage}\n\nAnswer with JSON: {\"nodes\": [{\"id\": \"s1\", \"thread_id\": \"T1\"}, ...]}.",
    "edge": "Read the numbered sentences and the events found in them. Name the interval relation between events that the text relates, with one of: " + ", ".join(("equals", "before", "after", "meets", "met-by", "overlaps", "overlapped-by", "starts", "started-by", "during", "contains", "finishes", "finished-by")) + ". Also list groups of events of different storylines that share one moment.\n\n{passage}\n\nEvents: {so_far}\n\nAnswer with JSON: {\"edges\": [{\"node_i\": \"s1\", \"node_j\": \"s2\", \"allen_relation\": \"before\", \"evidence_span\": \"...\"}], \"convergence_points\": [{\"members\": [\"s1\", \"s4\"], \"shared_detail\": \"...\"}]}.",
    "critique": "Here are numbered sentences and what was found in them. Which moments shared by events of different storylines were missed?\n\n{passage}\n\nFound so far: {so_far}\n\nAnswer with JSON: {\"edges\": [], \"convergence_points\": [{\"members\": [\"s1\", \"s4\"], \"shared_detail\": \"...\"}]}.",
    "direct": "Read the numbered sentences below. Assign each to a storyline, put all of them into the order in which they happened, and list pairs that happened at the same moment.\n\n{passage}\n\nAnswer with JSON: {\"events\": [{\"id\": \"s1\", \"thread_id\": \"T1\"}], \"global_order\": [\"s1\"], \"convergence_points\": [[\"s1\", \"s2\"]]}.",
}


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


class HttpModel:
    """Chat completions at a URL, temperature 0, JSON replies; waits and tries again when told to."""

    def __init__(self, url: str, model: str, key: str = ""):
        self.url, self.model, self.key = url, model, key

    def complete(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "user", "content": prompt}]}).encode()
        for attempt in range(POSTS):
            ask = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            try:
                with urllib.request.urlopen(ask, timeout=TIMEOUT) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as error:
                if error.code != 429 or attempt == POSTS - 1:
                    raise
                time.sleep(float(error.headers.get("Retry-After", 2**attempt)))
        raise RuntimeError("no reply")


def first_object(text: Column) -> Column:
    """The text from the first brace to the last."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def complete(prompts: DataFrame, model: Model, required: list[str], prompt_col: str = "prompt") -> DataFrame:
    """prompts with reply (JSON text) and tries. A reply that isn't JSON or lacks a key is sent back with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in parts:
            replies, tries = [], []
            for prompt in table[prompt_col]:
                ask, reply = prompt, None
                for n in range(1, REPLIES + 1):
                    text = model.complete(ask)
                    try:
                        got = json.loads(text[text.index("{") : text.rindex("}") + 1])
                        missing = [k for k in required if k not in got]
                        if not missing:
                            reply = json.dumps(got)
                            break
                        error = f"missing keys: {', '.join(missing)}"
                    except ValueError as broken:
                        error = str(broken)
                    ask = f"{prompt}\n\nYour last reply could not be used ({error}). Reply with one JSON object."
                replies.append(reply), tries.append(n)
            yield table.assign(reply=replies, tries=tries)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{schema}, reply string, tries int")


def recorded(calls: DataFrame, replies: DataFrame) -> DataFrame:
    """calls (run_id, call_no) with their recorded reply; a call without one raises when it is read."""
    got = calls.join(replies.select("run_id", "call_no", F.col("reply").alias("_reply")), ["run_id", "call_no"], "left")
    none = F.raise_error(F.format_string("no recorded reply for run %s, call %s", F.col("run_id").cast("string"), F.col("call_no").cast("string"))).cast("string")
    return got.withColumn("reply", F.coalesce("_reply", none)).drop("_reply")
