"""Byte streams of files by path or URI, and the record parsers that read them."""

from __future__ import annotations

import glob
import gzip
import io
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO


def open_stream(path: str) -> BinaryIO:
    """A file by local path, or by a URI whose scheme Arrow's file systems know; unzipped if it is gzip."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        raw: BinaryIO = io.BufferedReader(system.open_input_file(name))
    else:
        raw = open(path.removeprefix("file://"), "rb")  # noqa: SIM115
    magic = raw.peek(2)[:2]
    return gzip.GzipFile(fileobj=raw) if magic == b"\x1f\x8b" else raw


def list_files(path: str) -> list[str]:
    """Files of a path: itself, those in a directory (hidden ones left out), or those of a pattern, in order."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.Directory:
            scheme = path.split("://", 1)[0]
            found = [f for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
            return sorted(f"{scheme}://{f.path}" for f in found)
        return [path]
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        return sorted(os.path.join(local, f) for f in os.listdir(local) if not f.startswith((".", "_")))
    found = sorted(glob.glob(local))
    if not found:
        raise FileNotFoundError(path)
    return found


def lines(stream: BinaryIO) -> Iterator[str]:
    for line in stream:
        yield line.decode("utf-8").rstrip("\r\n")


def parse_fastq(stream: BinaryIO) -> Iterator[tuple[str, str, str]]:
    """(title, sequence, quality) records, which may run over several lines.

    The quality ends when it is as long as the sequence, so lines of it may begin
    with @ or +.  Errors: a title without @, a repeated title that differs,
    blanks inside a sequence, and qualities of another length.
    """
    source = lines(stream)
    line = next(source, None)
    while line is not None and not line:
        line = next(source, None)
    while line is not None:
        if not line.startswith("@"):
            raise ValueError(f"a record must begin with @: {line[:40]!r}")
        title, seq = line[1:], []
        line = next(source, None)
        while line is not None and not line.startswith("+"):
            seq.append(line)
            line = next(source, None)
        if line is None:
            raise ValueError(f"the record ends early: {title!r}")
        if line[1:] and line[1:] != title:
            raise ValueError(f"the titles differ: {title!r} and {line[1:]!r}")
        bases = "".join(seq)
        if any(c.isspace() for c in bases):
            raise ValueError(f"blanks in the sequence of {title!r}")
        quality, size = [], 0
        line = next(source, None)
        while line is not None and (size < len(bases) or (not bases and line == "" and not quality)):
            quality.append(line)
            size += len(line)
            line = next(source, None)
        if size != len(bases):
            raise ValueError(f"{len(bases)} bases and {size} qualities: {title!r}")
        while line is not None and not line:
            line = next(source, None)
        yield title, bases, "".join(quality)


def parse_fasta(stream: BinaryIO, width: int) -> Iterator[tuple[str, int, int, str]]:
    """(contig, chunk, chunk_start, bases): sequences in chunks of ``width``, never whole in memory."""
    contig, chunk, held = None, 0, ""
    for line in lines(stream):
        if line.startswith(">"):
            if contig is not None and (held or not chunk):
                yield contig, chunk, chunk * width, held
            contig, chunk, held = line[1:].split()[0] if line[1:].split() else "", 0, ""
        elif contig is not None:
            held += line.strip()
            while len(held) > width:
                yield contig, chunk, chunk * width, held[:width]
                held, chunk = held[width:], chunk + 1
        elif line.strip():
            raise ValueError("sequence before the first >")
    if contig is not None and (held or not chunk):
        yield contig, chunk, chunk * width, held


_BASES = "=ACMGRSVTWYHKDBN"
_CIGAR_REFERENCE = {0, 2, 3, 7, 8}


def read_bam_header(stream: BinaryIO) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (contig, length) of a BAM file, which is read from its beginning."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", stream.read(4))[0]))
    return text, contigs


def parse_bam(stream: BinaryIO) -> Iterator[tuple]:
    """Records of a BAM file as rows of ``schema.READS``; positions 0-based, the end from the CIGAR."""
    _, contigs = read_bam_header(stream)
    name_of = lambda i: contigs[i][0] if 0 <= i < len(contigs) else None
    while head := stream.read(4):
        data = stream.read(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate_ref, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        qname = data[at : at + l_name - 1].decode()
        at += l_name
        cigar = [{"op": c & 15, "len": c >> 4} for c in struct.unpack_from(f"<{n_cigar}I", data, at)]
        at += 4 * n_cigar
        packed = data[at : at + (l_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq] or None
        at += (l_seq + 1) // 2
        qual = list(data[at : at + l_seq])
        qual = None if not qual or qual[0] == 255 else qual
        span = sum(c["len"] for c in cigar if c["op"] in _CIGAR_REFERENCE)
        start = pos if pos >= 0 else None
        yield qname, flag, name_of(ref), start, None if start is None else start + span, mapq, cigar, seq, qual, name_of(mate_ref), mate_pos if mate_pos >= 0 else None


def parse_sam(stream: BinaryIO) -> Iterator[tuple]:
    """Records of a SAM file as rows of ``schema.READS``."""
    ops = {c: i for i, c in enumerate("MIDNSHP=X")}
    for line in lines(stream):
        if not line or line.startswith("@"):
            continue
        f = line.split("\t")
        cigar, n = [], ""
        for c in f[5] if f[5] != "*" else "":
            if c.isdigit():
                n += c
            else:
                cigar.append({"op": ops[c], "len": int(n)})
                n = ""
        start = int(f[3]) - 1 if int(f[3]) > 0 else None
        span = sum(c["len"] for c in cigar if c["op"] in _CIGAR_REFERENCE)
        mate = f[2] if f[6] == "=" else None if f[6] == "*" else f[6]
        seq, qual = (None if f[9] == "*" else f[9]), (None if f[10] == "*" else [ord(c) - 33 for c in f[10]])
        yield f[0], int(f[1]), None if f[2] == "*" else f[2], start, None if start is None else start + span, int(f[4]), cigar, seq, qual, mate, int(f[7]) - 1 if int(f[7]) > 0 else None


def encode_bam(contigs: list[tuple[str, int]], records: list[tuple], text: str = "") -> bytes:
    """A BAM file of a few records (rows of ``schema.READS``), as gzip members of at most 60 kB."""
    index = {c: i for i, (c, _) in enumerate(contigs)}
    out = bytearray(b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)))
    for c, n in contigs:
        out += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
    for qname, flag, contig, start, _, mapq, cigar, seq, qual, mate, mate_start in records:
        bases = seq or ""
        nibbles = [_BASES.index(c) for c in bases] + [0] * (len(bases) % 2)
        body = struct.pack("<iiBBHHHiiii", index.get(contig, -1), -1 if start is None else start, len(qname) + 1, mapq, 4680, len(cigar), flag, len(bases), index.get(mate, -1), -1 if mate_start is None else mate_start, 0)
        body += qname.encode() + b"\0" + b"".join(struct.pack("<I", c["len"] << 4 | c["op"]) for c in cigar)
        body += bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True)) + (bytes(qual) if qual else b"\xff" * len(bases))
        out += struct.pack("<i", len(body)) + body
    return b"".join(gzip.compress(bytes(out[i : i + 60_000])) for i in range(0, len(out), 60_000))
