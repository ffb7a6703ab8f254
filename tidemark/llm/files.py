"""Files that tasks write into and read from the shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def local_path(path: str) -> str | None:
    """The mounted path of file: addresses and plain paths, None for other file systems."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return unquote(parsed.path) if parsed.scheme else path
    return None


@contextmanager
def open_output(path: str) -> Iterator[BinaryIO]:
    """Writes under another name and renames at the end, so that a lost or repeated task leaves no half file."""
    own = local_path(path)
    if own is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        draft = os.path.join(os.path.dirname(own), f"_{uuid.uuid4().hex}")
        with open(draft, "wb") as f:
            yield f
        os.replace(draft, own)
    else:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        draft = f"{os.path.dirname(at)}/_{uuid.uuid4().hex}"
        system.create_dir(os.path.dirname(at), recursive=True)
        with system.open_output_stream(draft) as f:
            yield f
        system.move(draft, at)


def open_input(path: str) -> BinaryIO:
    own = local_path(path)
    if own is not None:
        return open(own, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)
