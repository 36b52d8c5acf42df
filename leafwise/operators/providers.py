"""Model calls as plug-ins: a registry of batch functions, and one of clients whose answers are kept as they come."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from itertools import groupby

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import sanitize
from leafwise.operators.figures import image_jobs
from leafwise.operators.project import project
from leafwise.schema import conform

#: Fixed value: what a figure without any usable answer says.
UNRECOGNISED = "[图片内容无法识别]"
REGISTRY: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register(name: str) -> Callable:
    """Decorator: a function from a Series of prompts to a Series of answers (NULL: failed)."""

    def keep(f: Callable[[pd.Series], pd.Series]) -> Callable[[pd.Series], pd.Series]:
        REGISTRY[name] = f
        return f

    return keep


@register("stub")
def stub(prompts: pd.Series) -> pd.Series:
    """A deterministic answer, for tests and dry runs."""
    return "Figure of " + prompts.str.len().astype(str) + " letters"


def answers(requests: DataFrame, *, providers: list[str], prompt: str = "prompt", strict: bool = False, valid: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """`requests` with vision_text: the first provider in order that answers; unusable answers give the fixed mark.

    A provider that raises has failed for its batch and the next one is asked. A
    blank answer counts as none, and so does one that `valid` (a function from a
    Series of answers to a Series of booleans) rejects.
    """
    tried = [REGISTRY[p] for p in providers]

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        for f in tried:
            left = out.isna()
            if not left.any():
                break
            try:
                got = f(prompts[left])
            except Exception:  # noqa: BLE001 - whatever a plug-in raises, the next one has its turn
                continue
            good = got.notna() & (got.fillna("").str.strip() != "")
            if valid is not None and good.any():
                good &= valid(got.fillna("")).astype(bool)
            out[left] = got.where(good, None)
        return out

    clean = sanitize(F.col("_raw"), strict=strict)
    return requests.withColumn("_raw", ask(prompt)).withColumn("vision_text", F.when(F.coalesce(clean, F.lit("")) == "", UNRECOGNISED).otherwise(clean)).drop("_raw")


Client = Callable[[str], str | None]
#: Functions that set a client up; called once in each task that needs it.
CLIENTS: dict[str, Callable[[], Client]] = {}


def register_client(name: str) -> Callable:
    """Decorator: a function without arguments that gives the function from a prompt to an answer."""

    def keep(f: Callable[[], Client]) -> Callable[[], Client]:
        CLIENTS[name] = f
        return f

    return keep


@register_client("stub")
def stub_client() -> Client:
    return lambda text: f"Figure of {len(text)} letters"


class Journal:
    """Answers of one bucket of requests, kept as lines of JSON in a folder that all machines see.

    A task reads what earlier attempts have left and adds a file of its own, line
    by line as answers come; a line that was cut off is passed over.
    """

    def __init__(self, path: str, bucket: int) -> None:
        self.store, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
        self.folder, self.out = f"{at}/bucket={bucket}", None
        self.held: dict[str, tuple[str, str]] = {}
        for info in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.store.open_input_stream(info.path) as file:
                for line in file.read().decode(errors="replace").split("\n"):
                    try:
                        kept = json.loads(line)
                        self.held[kept["key"]] = (kept["provider"], kept["answer"])
                    except (ValueError, KeyError, TypeError):
                        continue

    def add(self, key: str, provider: str, answer: str) -> None:
        if self.out is None:
            self.store.create_dir(self.folder)
            self.out = self.store.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
        self.out.write((json.dumps({"key": key, "provider": provider, "answer": answer}) + "\n").encode())
        self.out.flush()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def completions(requests: DataFrame, journal: str, *, providers: list[str], key: str = "key", prompt: str = "prompt", concurrent: int = 8, buckets: int = 64, valid: Callable[[str], bool] | None = None) -> DataFrame:
    """key, provider, answer, failures for each distinct key of `requests`: the first client in order that gives a usable answer, and the kinds of errors before it.

    A task sets up each client once, when it first needs it, and has `concurrent`
    calls under way at most. An answer is written to the folder `journal` as soon
    as it comes, so a task that is run again, or another run over the same
    requests, asks only for what is not there yet (calls that were under way when
    an executor was lost are made again). Requests without any usable answer have
    NULL and are asked again by the next run. A null prompt counts as empty; of
    several prompts of a key the least is asked; null keys give no row.
    """
    setups = [(p, CLIENTS[p]) for p in providers]
    asked = requests.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.min(F.coalesce(prompt, F.lit(""))).alias("prompt"))
    dealt = asked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, Client] = {}

        def ask(text: str) -> tuple[str | None, str | None, list[str]]:
            failures: list[str] = []
            for name, client in clients.items():
                try:
                    got = client(text)
                except Exception as e:  # noqa: BLE001 - whatever a plug-in raises, the next one has its turn
                    failures.append(type(e).__name__)
                    continue
                if got is not None and got.strip() and (valid is None or valid(got)):
                    return name, got, failures
                failures.append("Unusable")
            return None, None, failures

        def rows() -> Iterator[tuple[int, str, str]]:
            for batch in batches:
                yield from zip(batch["bucket"].tolist(), batch["key"].tolist(), batch["prompt"].tolist(), strict=True)

        def done(calls: dict[Future, str], book: Journal, *, down_to: int) -> Iterator[tuple]:
            while len(calls) > down_to:
                for call in wait(calls, return_when=FIRST_COMPLETED).done:
                    name, answer, failures = call.result()
                    own = calls.pop(call)
                    if answer is not None:
                        book.add(own, name, answer)
                    yield own, name, answer, failures

        frame = lambda some: pd.DataFrame(some, columns=["key", "provider", "answer", "failures"])
        with ThreadPoolExecutor(concurrent) as pool:
            for bucket, own in groupby(rows(), key=lambda r: r[0]):
                book, calls, out = Journal(journal, bucket), {}, []
                try:
                    for _, name, text in own:
                        if name in book.held:
                            out.append((name, *book.held[name], []))
                        else:
                            for p, setup in setups:
                                if p not in clients:
                                    clients[p] = setup()
                            out += done(calls, book, down_to=concurrent - 1)
                            calls[pool.submit(ask, text)] = name
                        if len(out) >= 1000:
                            yield frame(out)
                            out = []
                    out += done(calls, book, down_to=0)
                finally:
                    book.close()
                yield frame(out)

    return dealt.mapInPandas(run, "key string, provider string, answer string, failures array<string>")


def describe(jobs: DataFrame, *, providers: list[str], strict: bool = False) -> DataFrame:
    """doc_id, block_seq, image_seq, vision_text for every job: each distinct request is asked once and its answer goes to all its places."""
    asked = jobs.groupBy("doc_id", "image_seq").agg(F.min_by("prompt", "block_seq").alias("prompt"))
    got = answers(asked, providers=providers, strict=strict).select("doc_id", "image_seq", "vision_text")
    return jobs.select("doc_id", "block_seq", "image_seq").join(got, ["doc_id", "image_seq"])


def parse_with_images(blocks: DataFrame, files: DataFrame, *, providers: list[str], chunk_type: bool = False, every: bool = False, strict: bool = False) -> DataFrame:
    """Blocks to chunks with a model's words for the figures: jobs, answers, and the two-stage projection."""
    told = describe(image_jobs(blocks, files, every=every, strict=strict), providers=providers, strict=strict)
    met = conform(blocks).drop("image_seq").join(told, ["doc_id", "block_seq"], "left")
    if strict:  # what stands around a figure is not its text
        bare = ("img_caption", "img_footnote", "image_caption", "image_footnote", "chart_caption", "chart_footnote")
        met = met.withColumns({c: F.when(F.col("image_seq").isNull(), F.col(c)) for c in bare})
    return project(met, mode="two_stage", chunk_type=chunk_type)
