"""WARC archives of captured pages, and their index merged from locally sorted runs.

Each task writes gzip WARC files, a member for each record, and the index of each file as a run sorted by URL
key and time. Runs are dealt out by ranges of that key; each task takes the slices of runs in its range as they
are and merges them with a loser tree. A range has a bounded number of rows, also of one URL, since time and
record are part of its bounds. Ranges follow one another, so the whole is ordered.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import marked_among, new_path, partitions_for, with_groups, written

FILE_BYTES = 32_000_000
#: A page without a capture time of its own is dated by its id, in seconds from here.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_DIGEST = hashlib.sha1(b"").hexdigest()
INDEX = "url_key string, timestamp string, page_id long, record_id string, record_type string, payload_digest string, refers_to long, file string, offset long, length long, run_seq long"
RECORD = "record_id string, page_id long, url string, timestamp string, record_type string, payload_digest string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host parts reversed, then path and query, lower-case, no scheme, www or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _date(page_id: int | None) -> str:
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _uri(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def _file_info(name: str) -> bytes:
    """The record at the head of a file."""
    block = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {_date(None)}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(row: dict, record_id: str, timestamp: str) -> bytes:
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else (row["html"] or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {timestamp}", f"WARC-Payload-Digest: sha1:{row['digest']}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + _uri(row["url"]))
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {_date(row['refers_to'])}", f"X-Refers-To-Page-Id: {row['refers_to']}"]
        if row["first_url"] is not None:
            head.append("WARC-Refers-To-Target-URI: " + _uri(row["first_url"]))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_from_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each page into the shared folder and returns the index of all runs.

    Of pages with equal payloads of at least `dedup_from_bytes` bytes, that with the smallest id is a response
    and the others revisit it; a null id counts as largest, rows that repeat id and payload are marked alike.
    A null html is an empty payload. A lost task writes new files when it runs again; the index names only
    those of the tasks that ended.
    """
    import pyarrow.fs

    folder = folder or new_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(body.cast("binary")).alias("sha1"), (F.octet_length(body) >= dedup_from_bytes).alias("counts"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = rows.where("counts").groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.min_by("url", named).alias("first_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    firsts = written(firsts, "first-payloads")
    # a page whose payload is surely its own needs no join, and its html no shuffle
    marked = marked_among(rows.withColumn("key", F.xxhash64("sha1")), firsts.select(F.xxhash64("sha1").alias("key")), "key", "maybe").drop("key")
    alone = marked.where("NOT maybe").drop("maybe", "counts").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    met = with_groups(marked.where("maybe"), firsts, ["sha1"], "n", ["page_id", "url"], "left")
    revisit = F.col("counts") & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    met = met.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("first_url"))
    typed = alone.unionByName(met)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, run = None, "", 0, []

        def closed() -> pd.DataFrame:
            out.close()
            index = pd.DataFrame(sorted(run, key=lambda r: (r[0], r[1], r[3])), columns=[c.split()[0] for c in INDEX.split(", ")][:-1])
            index["page_id"], index["refers_to"] = index["page_id"].astype("Int64"), index["refers_to"].astype("Int64")
            return index.assign(run_seq=range(len(index)))

        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if out is None:
                    name, at, run = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # the members are compressed already
                    info = gzip.compress(_file_info(name), 6, mtime=0)
                    out.write(info)
                    at = len(info)
                row["digest"] = base64.b32encode(bytes.fromhex(row.pop("sha1"))).decode()
                row["page_id"], row["refers_to"] = (None if row[c] is None else int(row[c]) for c in ("page_id", "refers_to"))
                record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{at}')}"
                timestamp = _date(row["page_id"])
                raw = gzip.compress(_record(row, record_id, timestamp), 6, mtime=0)
                out.write(raw)
                run.append((url_key(row["url"]), timestamp, row["page_id"], record_id, row["record_type"], row["digest"], row["refers_to"], name, at, len(raw)))
                at += len(raw)
                if at >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(typed.mapInPandas(write, INDEX), "warc-index").withColumn("folder", F.lit(folder))


def loser_tree(runs: list) -> Iterator:
    """Merges sorted iterables. Inner node i holds the loser of the match played there; the winner goes up."""
    k = len(runs)
    heads = [iter(run) for run in runs]
    now: list = [next(h, None) for h in heads]

    def beats(a: int, b: int) -> bool:
        return now[b] is None or (now[a] is not None and (now[a], a) < (now[b], b))

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and now[best] is not None:
        yield now[best]
        now[best] = next(heads[best], None)
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def merge_index(index: DataFrame, rows_each: int = 500_000) -> DataFrame:
    """The index in order of URL key and time: `range, position` give each entry's place, `capture_after` the time of the capture before it where that has the same URL key, in its range or an earlier one."""
    parts = partitions_for(index.sparkSession, index.count(), rows_each)
    dealt = index.repartitionByRange(parts, "url_key", "timestamp", "record_id").sortWithinPartitions("file", "run_seq")  # the slices of runs, one after the other
    columns = dealt.columns

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(frames)
        if not whole:
            return
        rows = pd.concat(whole, ignore_index=True)
        keys, times, ids, files = (rows[c].tolist() for c in ("url_key", "timestamp", "record_id", "file"))
        cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        runs = [zip(keys[a:b], times[a:b], ids[a:b], range(a, b), strict=True) for a, b in zip(cuts, cuts[1:], strict=False)]
        order, after, last = [], [], (None, None)
        for key, time, _, i in loser_tree(runs):
            order.append(i)
            after.append(last[1] if last[0] == key else None)
            last = key, time
        merged = rows.iloc[order].reset_index(drop=True)
        yield merged.assign(range=TaskContext.get().partitionId(), position=range(len(merged)), capture_after=after)

    merged = written(dealt.mapInPandas(merge, ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in columns) + ", range int, position long, capture_after string"), "warc-merged")
    # the last capture of a range, one row each, comes before the first of the next range that has rows
    lasts = merged.groupBy("range").agg(F.max_by(F.struct("url_key", "timestamp"), "position").alias("last"))
    before = lasts.select("range", F.lag("last").over(Window.orderBy("range")).alias("before"))
    first = (F.col("position") == 0) & (F.col("before.url_key") == F.col("url_key"))
    return merged.join(F.broadcast(before), "range", "left").withColumn("capture_after", F.when(first, F.col("before.timestamp")).otherwise(F.col("capture_after"))).select(*merged.columns)


def read_archives(index: DataFrame) -> DataFrame:
    """The records of all files that the index names, read from the files alone. Each file is streamed by one task."""
    import pyarrow.fs

    files = index.select("folder", "file").distinct()
    files = files.repartition(partitions_for(index.sparkSession, files.count(), 1), "file")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder, file in zip(frame["folder"], frame["file"], strict=True):
                fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as lines:
                    while lines.readline().startswith(b"WARC/"):
                        head = {}
                        while (line := lines.readline().rstrip(b"\r\n")):
                            name, _, value = line.decode().partition(": ")
                            head[name] = value
                        block = lines.read(int(head["Content-Length"]))
                        lines.read(4)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        revisit = head["WARC-Type"] == "revisit"
                        rows.append((head["WARC-Record-ID"][1:-1], head.get("X-Page-Id"), head.get("WARC-Target-URI"), head["WARC-Date"], head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Refers-To-Page-Id"), None if revisit else block.partition(b"\r\n\r\n")[2]))
                        size += len(block)
                        if size > 8_000_000:
                            yield _records(rows)
                            rows, size = [], 0
                yield _records(rows)

    return files.mapInPandas(read, RECORD)


def _records(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    for c in ("page_id", "refers_to"):
        out[c] = out[c].map(lambda x: None if x is None else int(x)).astype("Int64")
    return out


def verified(records: DataFrame) -> DataFrame:
    """Records with the size of the full payload in `payload_bytes`; a revisit takes it from the response it refers to.

    `intact` tells whether a response's payload still has the digest in its header.
    """
    checked = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.when(F.col("payload").isNotNull(), F.sha1("payload")))

    @F.pandas_udf("string")
    def bare(sha1: pd.Series) -> pd.Series:
        return sha1.map(lambda x: None if x is None else base64.b32encode(bytes.fromhex(x)).decode())

    checked = checked.withColumn("found", bare("sha1")).drop("payload", "sha1")
    sizes = checked.where("record_type = 'response'").groupBy(F.col("page_id").alias("to_id"), F.col("found").alias("to_digest")).agg(F.max("payload_bytes").alias("to_bytes"))
    # the size of what Python returns is unknown to the planner, which must not broadcast it
    joined = checked.hint("merge").join(sizes.hint("merge"), (F.col("refers_to") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest")), "left")
    return joined.select("record_id", "page_id", "url", "timestamp", "record_type", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), F.coalesce("found", "to_digest").alias("payload_digest"), "refers_to", (F.coalesce("found", "to_digest") == F.col("payload_digest")).alias("intact"))


def capture_histories(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_from_bytes: int = 0) -> DataFrame:
    """Archives the pages, reads the archives back and places each record in the merged index."""
    index = write_archives(pages, id_col, url_col, html_col, dedup_from_bytes)
    order = merge_index(index).select("record_id", "url_key", "file", "offset", "length", "range", "position", "capture_after")
    return verified(read_archives(index)).hint("merge").join(order.hint("merge"), "record_id").drop("record_id")
