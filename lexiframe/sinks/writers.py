"""Writers: CSV dialects, JSON lines, reports, audio slices, bundles."""

from __future__ import annotations

import io
import os
import tarfile
import wave

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.audio import SR, decode, encode_wav


def quoted_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, quote='"', escape='"')


def plain_csv(df: DataFrame, path: str) -> None:
    """Fields quoted where needed."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def partitioned(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def report(df: DataFrame, columns: dict[str, Column], path: str) -> None:
    """One JSON row of aggregates."""
    df.agg(*[c.alias(k) for k, c in columns.items()]).coalesce(1).write.mode("overwrite").json(path)


def merged_report(old: Column, new: Column, drop_prefix: str) -> Column:
    """A report map with the keys of a prefix dropped and new ones laid over it."""
    kept = F.map_filter(old, lambda k, _: ~k.startswith(drop_prefix))
    kept = F.map_filter(kept, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def word_list(df: DataFrame, word: str, order: list[Column], k: int) -> str:
    """The first k words in one line."""
    return ", ".join(r[word] for r in df.orderBy(*order).limit(k).collect())


def files(df: DataFrame, name: str, content: str, folder: str) -> int:
    """Writes each row's bytes under its name below a folder that workers share, by the workers; returns how many were written. A file is
    named when it is whole, so that a repeated task writes the same."""

    def work(batches):
        import pandas as pd
        from pyarrow import fs

        to, root = fs.FileSystem.from_uri(folder)
        to.create_dir(root, recursive=True)
        for b in batches:
            for n, c in zip(b[name], b[content], strict=True):
                tmp = f"{root}/.{n}.{os.getpid()}"
                with to.open_output_stream(tmp) as f:
                    f.write(bytes(c))
                to.move(tmp, f"{root}/{n}")
            yield pd.DataFrame({"n": [len(b)]})

    return df.select(name, content).mapInPandas(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def audio_slices(rows: DataFrame, content: str, folder: str) -> DataFrame:
    """Writes WAV slices (name, start, end of the content) into a shared folder by the workers; returns (name, bytes, error)."""

    def work(batches):
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            out = []
            for name, c, s, e in zip(b["name"], b[content], b["start"], b["end"], strict=True):
                try:
                    x = decode(bytes(c))[int(s * SR) : int(e * SR)]
                    data = encode_wav(x)
                    tmp = os.path.join(folder, f".{name}.{os.getpid()}")
                    with open(tmp, "wb") as f:
                        f.write(data)
                    os.replace(tmp, os.path.join(folder, name))  # a retried task writes the same file
                    out.append((name, len(data), None))
                except Exception as ex:  # noqa: BLE001
                    out.append((name, 0, type(ex).__name__))
            yield pd.DataFrame(out, columns=["name", "bytes", "error"])

    return rows.select("name", content, "start", "end").mapInPandas(work, "name string, bytes long, error string")


def joined_wav(parts: list[bytes]) -> bytes:
    """Parts of one call in one file; a part that isn't 16 kHz mono is an error."""
    got = []
    for p in parts:
        with wave.open(io.BytesIO(p)) as w:
            if (w.getframerate(), w.getnchannels()) != (SR, 1):
                raise ValueError("parts must be 16 kHz mono")
        got.append(decode(p))
    return encode_wav(np.concatenate(got) if got else np.zeros(0))


def joined_calls(parts: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, content, parts): the parts of each call as one WAV. A call's parts meet in one task."""

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [joined_wav([bytes(x) for x in pdf[content]])], "parts": [len(pdf)]})

    kind = parts.schema[key].dataType.simpleString()
    return parts.select(key, order, content).groupBy(key).applyInPandas(join, f"{key} {kind}, content binary, parts long")


def bare_header_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, the header bare: one file, for hand-over of small sets."""
    fields = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    head = df.sparkSession.createDataFrame([(0, ",".join(df.columns))], "o int, line string")
    lines = head.union(df.select(F.lit(1), F.concat_ws(",", *fields)))
    lines.coalesce(1).sortWithinPartitions("o").select("line").write.mode("overwrite").text(path)


def bundle(files: list[tuple[str, bytes]], path: str) -> None:
    """A tar of a few small files, by the driver."""
    with tarfile.open(path, "w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def unbundle(path: str, folder: str) -> list[str]:
    with tarfile.open(path) as t:
        t.extractall(folder, filter="data")
        return t.getnames()
