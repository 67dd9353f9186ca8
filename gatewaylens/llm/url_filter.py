"""URL filter: a sorted array of 64-bit digests, memory-mapped, probed by vectorised binary search.

Each rule is a text `host + path prefix` and one digest. A url asks for all rules that could fit it: its host and every
parent domain, with every prefix of its path that is as long as some rule's. The digests of these are looked up
in the sorted array; where one is found, the stored text is compared, so a collision decides nothing.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewaylens.session import new_path

# Rules are sent to every executor as files: about 8 bytes and a text each, so at most this many.
MOST_RULES = 20_000_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def _digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def build(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Writes the rules as sorted files, sends them to all executors, and returns their name.

    Of rules with the same text the first counts. Hosts are lower case; a path begins with `/` or is empty.
    """
    stored: dict[str, Rule] = {}
    for rule in rules:
        if len(stored) >= MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        stored.setdefault(rule.text, rule)
    ordered = sorted(stored.values(), key=lambda r: (_digest(r.text.encode()), r.text))
    texts = [r.text.encode() for r in ordered]
    name = f"rules-{uuid.uuid4().hex}"
    columns = {
        "digests": np.array([_digest(t) for t in texts], np.uint64),
        "ends": np.cumsum([0, *map(len, texts)]).astype(np.int64),
        "texts": np.frombuffer(b"".join(texts), np.uint8),
        "hosts": np.array([len(r.host.encode()) for r in ordered], np.int64),
        "blocks": np.array([r.verdict == "block" for r in ordered], bool),
        "lengths": np.unique(np.array([len(r.path) for r in ordered], np.int64)),
        "labels": np.unique(np.array([r.host.count(".") + 1 for r in ordered], np.int64)),
    }
    # Written to the shared folder, where they stay for executors that join later; addFile has each executor fetch a copy.
    folder = new_path(spark, name)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    for column, values in columns.items():
        with store.open_output_stream(f"{path}/{name}-{column}.npy") as out:
            held = io.BytesIO()
            np.save(held, values)
            out.write(held.getvalue())
        spark.sparkContext.addFile(f"{folder}/{name}-{column}.npy")
    return name


@lru_cache(maxsize=2)
def _mapped(name: str) -> dict[str, np.ndarray]:
    columns = ("digests", "ends", "texts", "hosts", "blocks", "lengths", "labels")
    return {c: np.load(SparkFiles.get(f"{name}-{c}.npy"), mmap_mode="r") for c in columns}


def _keys(host: str, path: str, lengths: list[int], labels: list[int]) -> list[bytes]:
    """Texts of all rules that would fit: parent domains with as many labels as some rule's host, and path prefixes."""
    parts = host.rsplit(".", max(labels, default=1)) if host else []
    hosts = [".".join(parts[-n:]) for n in labels if n < len(parts) or ".".join(parts[-n:]) == host]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [(h + p).encode() for h in dict.fromkeys(hosts) if h for p in prefixes]


def probe(rules: dict[str, np.ndarray], keys: list[bytes]) -> np.ndarray:
    """Number of the stored rule for each key, -1 if there is none. The digest finds, the text confirms."""
    digests, ends, texts = rules["digests"], rules["ends"], rules["texts"]
    found = np.full(len(keys), -1, np.int64)
    if not len(digests) or not keys:
        return found
    wanted = np.fromiter(map(_digest, keys), np.uint64, len(keys))
    low, high = np.searchsorted(digests, wanted, "left"), np.searchsorted(digests, wanted, "right")
    for n in np.flatnonzero(low < high):
        for at in range(low[n], high[n]):
            if texts[ends[at]:ends[at + 1]].tobytes() == keys[n]:
                found[n] = at
    return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no `://`.

    The host is what stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case;
    the path goes on up to `?`, `#` or the end.
    """
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    none = url.isNull() | (at == 0)
    return F.when(none, "").otherwise(host), F.when(none, "").otherwise(path)


def judge(pages: DataFrame, rules: str, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; of several the longest wins
    (the text of host and path; of equal lengths the longer host). Without one, rule is null and the verdict is `otherwise`: an url that is in no list is
    not blocked. Null, empty and broken urls have an empty host and no rule. Columns that have a result's name are replaced.
    """
    host, path = url_parts(F.col(url))
    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in made]
    base = pages.select(*[f"`{c}`" for c in kept], host.alias("host"), path.alias("path"))
    schema = ", ".join([base._jdf.schema().toDDL(), "rule STRING", "verdict STRING"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = _mapped(rules)
        lengths, labels = stored["lengths"].tolist(), stored["labels"].tolist()
        for batch in batches:
            per_url = [_keys(h, p, lengths, labels) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            found = probe(stored, [k for keys in per_url for k in keys])
            texts, verdicts, at = [], [], 0
            for keys in per_url:
                hits = [(len(keys[n].decode()), stored["hosts"][found[at + n]], int(found[at + n])) for n in range(len(keys)) if found[at + n] >= 0]
                at += len(keys)
                if not hits:
                    texts.append(None)
                    verdicts.append(otherwise)
                    continue
                best = max(hits)[-1]
                texts.append(stored["texts"][stored["ends"][best]:stored["ends"][best + 1]].tobytes().decode())
                verdicts.append("block" if stored["blocks"][best] else "allow")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array(verdicts, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    return base.mapInArrow(run, schema)
