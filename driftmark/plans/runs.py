"""Versioned runs: paths, hashes, manifests and lineage, on the driver."""

from __future__ import annotations

import hashlib
import re
import subprocess
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from driftmark.sources import tables


def file_sha256(path: str | Path, chunk: int = 65536) -> str:
    """The SHA-256 of a file, read in chunks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def run_id(value: str) -> str:
    """A run id: a lower-case letter, then 2 to 63 lower-case letters, digits or underscores."""
    if not re.fullmatch(r"[a-z][a-z0-9_]{2,63}", value):
        raise ValueError(f"not a run id: {value!r}")
    return value


@dataclass(frozen=True)
class Run:
    """Where a run's files are."""

    root: Path
    name: str

    def __post_init__(self):
        run_id(self.name)

    @property
    def folder(self) -> Path:
        return Path(self.root) / "runs" / self.name

    @property
    def predictions(self) -> Path:
        return self.folder / "predictions.csv"

    @property
    def raw_responses(self) -> Path:
        return self.folder / "raw_responses.jsonl"

    @property
    def manifest(self) -> Path:
        return self.folder / "run_manifest.json"

    def prepare(self, overwrite: bool = False) -> Path:
        """The run's folder, made; an existing run is only overwritten on request."""
        if self.folder.exists() and any(self.folder.iterdir()) and not overwrite:
            raise FileExistsError(self.folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        return self.folder


def commit_of(folder: str | Path) -> str:
    """The git commit of a folder, "" outside a repository."""
    got = subprocess.run(["git", "-C", str(folder), "rev-parse", "HEAD"], capture_output=True, text=True)
    return got.stdout.strip() if got.returncode == 0 else ""


def freeze(inputs: dict[str, Path], columns: dict[str, list[str]], rows: dict[str, int], code: str | Path = ".") -> dict:
    """A manifest of input files: hash, size, rows and columns of each, versions and commit."""
    import pyarrow
    import pyspark

    data = {n: {"path": str(p), "sha256": file_sha256(p), "size_bytes": Path(p).stat().st_size, "row_count": rows[n], "columns": columns[n]} for n, p in inputs.items()}
    return {"created": datetime.now(timezone.utc).isoformat(), "commit": commit_of(code), "versions": {"pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__}, "datasets": data}


def finish(manifest: dict, outputs: dict[str, Path], rows: dict[str, int], path: str | Path) -> dict:
    """The manifest with the hashes and row counts of outputs, written last."""
    done = {**manifest, "output_hashes": {n: file_sha256(p) for n, p in outputs.items()}, "output_row_counts": rows}
    tables.write_json(done, path)
    return done


def verify(manifest: dict, files: dict[str, Path]) -> list[str]:
    """Names of files that are missing or differ from the manifest (inputs and outputs)."""
    known = {n: d["sha256"] for n, d in manifest.get("datasets", {}).items()} | manifest.get("output_hashes", {})
    return sorted(n for n, p in files.items() if not Path(p).exists() or known.get(n) != file_sha256(p))


def lineage(run: Run, products: dict[str, Path]) -> dict:
    """What a set of report files was made from."""
    return {"run_id": run.name, "manifest_sha256": file_sha256(run.manifest), "products": {n: file_sha256(p) for n, p in products.items()}}
