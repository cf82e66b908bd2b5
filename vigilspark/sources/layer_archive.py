"""Rule layers as files that can be carried: a tar.gz whose bytes follow from its rules alone, and back.

An archive holds a file for each rule and a manifest of their SHA-256. It is written and read where the driver runs, within
the bounds of a rule set; what is read is held against the manifest, and nothing is unpacked to disk."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import tarfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.operators.rules import MOST_BYTES

MANIFEST = "manifest.json"
MOST_RULES = 100_000
_NAME = re.compile(r"[A-Za-z0-9_-]{1,80}/[A-Za-z_][A-Za-z0-9_]{0,255}\.yar")
COLUMNS = "layer string, identifier string, body string"


def deterministic_tar(files: list[tuple[str, bytes]]) -> bytes:
    """The same bytes for the same files, in any order, at any time, by anyone."""
    held = io.BytesIO()
    with gzip.GzipFile(fileobj=held, mode="wb", filename="", mtime=0, compresslevel=9) as zipped, tarfile.open(fileobj=zipped, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in sorted(files):
            entry = tarfile.TarInfo(name)
            entry.size, entry.mode = len(data), 0o644
            tar.addfile(entry, io.BytesIO(data))
    return held.getvalue()


def export_layers(rules: DataFrame, path: str) -> str:
    """Writes rules (layer, identifier, body) to a local path; returns the archive's SHA-256. Their size is checked before
    they are gathered; a name that repeats or is no name of a rule is an error."""
    size, n = rules.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)), F.count(F.lit(1))).first()
    if size > MOST_BYTES or n > MOST_RULES:
        raise ValueError(f"{n} rules of {size} bytes are over {MOST_RULES} and {MOST_BYTES}")
    files = [(f"{r.layer}/{r.identifier}.yar", (r.body or "").encode()) for r in rules.select("layer", "identifier", "body").collect()]
    bad = [name for name, _ in files if not _NAME.fullmatch(name)]
    if bad or len({name for name, _ in files}) < len(files):
        raise ValueError(f"not a rule's name: {min(bad)}" if bad else "a rule stands twice")
    listed = {name: hashlib.sha256(data).hexdigest() for name, data in sorted(files)}
    packed = deterministic_tar([*files, (MANIFEST, json.dumps(listed, indent=1, sort_keys=True).encode())])
    with open(path, "wb") as f:
        f.write(packed)
    return hashlib.sha256(packed).hexdigest()


def import_layers(spark: SparkSession, path: str) -> DataFrame:
    """layer, identifier, body of an archive. ValueError for anything but plain files of rules that the manifest lists, no more
    and no fewer, each with its sum; the archive is read within the bounds, whatever it says of itself."""
    found: dict[str, bytes] = {}
    left = MOST_BYTES + (16 << 20)
    try:
        with gzip.open(path, "rb") as zipped, tarfile.open(fileobj=io.BytesIO(_bounded(zipped, left + (64 << 20))), mode="r:") as tar:
            for entry in tar:
                if not entry.isreg() or not (entry.name == MANIFEST or _NAME.fullmatch(entry.name)) or entry.name in found:
                    raise ValueError(f"unexpected entry {entry.name!r}")
                left -= entry.size
                if left < 0 or len(found) > MOST_RULES:
                    raise ValueError("the archive is over its bounds")
                found[entry.name] = tar.extractfile(entry).read()
    except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
        raise ValueError(f"no archive of rules: {e}") from None
    try:
        listed = json.loads(found.pop(MANIFEST, b"null"))
        bodies = [(name.partition("/")[0], name.partition("/")[2].removesuffix(".yar"), data.decode()) for name, data in sorted(found.items())]
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        raise ValueError(f"no archive of rules: {e}") from None
    if listed != {name: hashlib.sha256(data).hexdigest() for name, data in found.items()}:
        raise ValueError("the manifest does not agree with the files")
    return spark.createDataFrame(bodies, COLUMNS)


def _bounded(stream, most: int) -> bytes:
    data = stream.read(most + 1)
    if len(data) > most:
        raise ValueError("the archive is over its bounds")
    return data
