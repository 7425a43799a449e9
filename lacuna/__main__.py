"""Command line: encode, decode, heal and stack files; ids and datagrams; sound transport; ``net`` (see lacuna.net)."""

from __future__ import annotations

import argparse
import hashlib
import os
import sys

import numpy as np

from lacuna.functions import bytes as B
from lacuna.functions import modem as M
from lacuna.operators import codec as C
from lacuna.sources import media


def read_folder(path: str) -> list[C.Chunk]:
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith(("chunk_", "recovery_")) and not name.endswith(".meta"):
            score = 0.0
            if os.path.exists(f"{path}/{name}.meta"):
                try:
                    score = float(open(f"{path}/{name}.meta").read())
                except ValueError:
                    score = 0.0
            out.append((name, open(f"{path}/{name}", "rb").read(), score))
    return out


def write_folder(chunks: list[C.Chunk], path: str) -> None:
    os.makedirs(path, exist_ok=True)
    for old in os.listdir(path):
        if old.startswith(("chunk_", "recovery_")):
            os.remove(f"{path}/{old}")
    for name, data, score in chunks:
        open(f"{path}/{name}", "wb").write(data)
        open(f"{path}/{name}.meta", "w").write(repr(score))


def save(f: C.Field, values: np.ndarray, path: str) -> None:
    open(path, "wb").write(media.write_png(values) if f.kind == "image" else media.write_wav(values, f.rate))


def content_id(uri: str) -> bytes:
    return hashlib.blake2s(uri.strip().encode(), digest_size=16).digest()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacuna")
    sub = p.add_subparsers(dest="what", required=True)
    e = sub.add_parser("encode")
    e.add_argument("source")
    e.add_argument("folder")
    e.add_argument("--version", type=int, default=3)
    e.add_argument("--blocks", type=int, default=32)
    e.add_argument("--kb", type=int)
    e.add_argument("--packet-bytes", type=int)
    e.add_argument("--quality", type=int, default=50)
    e.add_argument("--model", default="downsample")
    e.add_argument("--overhead", type=float, default=0.0)
    e.add_argument("--seed", type=int)
    for name in ("decode", "heal"):
        d = sub.add_parser(name)
        d.add_argument("folder")
        d.add_argument("target")
        d.add_argument("--most", type=int)
        d.add_argument("--by-gain", action="store_true")
        d.add_argument("--use-recovery", action="store_true", default=None)
        d.add_argument("--honest", action="store_true")
        d.add_argument("--kb", type=int, default=32)
        d.add_argument("--rounds", type=int, default=1)
        if name == "decode":
            d.add_argument("--confidence", action="store_true", help="write the confidence beside the target")
    s = sub.add_parser("stack")
    s.add_argument("target")
    s.add_argument("folders", nargs="+")
    s.add_argument("--no-align", action="store_true")
    for name in ("id", "frame-id"):
        i = sub.add_parser(name)
        i.add_argument("uri")
        if name == "frame-id":
            i.add_argument("frame", type=int)
    for name in ("inventory", "want"):
        i = sub.add_parser(name)
        i.add_argument("uri")
        i.add_argument("ids", type=int, nargs="*")
    t = sub.add_parser("sound-send")
    t.add_argument("folder")
    t.add_argument("target")
    t.add_argument("--uri", required=True)
    r = sub.add_parser("sound-receive")
    r.add_argument("source")
    r.add_argument("folder")
    r.add_argument("--uri")
    w = sub.add_parser("fix-wav")
    w.add_argument("source")
    w.add_argument("target")
    w.add_argument("--rate", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["net"]:
        from lacuna import net

        return net.main(argv[1:])
    a = parser().parse_args(argv)
    if a.what == "encode":
        data = open(a.source, "rb").read()
        if a.source.lower().endswith(".wav"):
            x, rate = media.read_wav(data)
            chunks = C.encode_audio(x, rate, a.version, a.blocks, a.kb, a.quality, model=a.model, overhead=a.overhead, seed=a.seed)
        else:
            chunks = C.encode_image(media.read_png(data), a.version, a.blocks, a.kb, a.packet_bytes, a.quality, model=a.model, overhead=a.overhead, seed=a.seed)
        write_folder(chunks, a.folder)
    elif a.what == "decode":
        f = C.gather(read_folder(a.folder), a.most, a.by_gain, a.use_recovery)
        if f is None:
            print("nothing decodes", file=sys.stderr)
            return 1
        if a.confidence:
            from lacuna.store import save_field

            print(save_field(f, a.target))
        else:
            save(f, C.render(f), a.target)
    elif a.what == "heal":
        chunks = read_folder(a.folder)
        if a.rounds > 1:
            healed, deltas, _ = C.heal_fixed_point(chunks, a.rounds, kb=a.kb, honest=a.honest)
            print(" ".join(f"{x:.6g}" for x in deltas))
        else:
            healed = C.heal(chunks, a.kb, a.honest, most=a.most, by_gain=a.by_gain, use_recovery=a.use_recovery)
        write_folder(healed, a.target)
    elif a.what == "stack":
        fields = [f for d in a.folders if (f := C.gather(read_folder(d))) is not None]
        save(fields[0], C.stack(fields, not a.no_align), a.target)
    elif a.what == "id":
        print(content_id(a.uri).hex())
    elif a.what == "frame-id":
        print(content_id(f"{a.uri}::{a.frame}").hex())
    elif a.what in ("inventory", "want"):
        kind = B.INVENTORY if a.what == "inventory" else B.WANT
        ids = sorted(set(a.ids))[: B.MOST_IDS]
        print((B.CONTROL_HEADER.pack(B.CONTROL, kind, content_id(a.uri), len(ids)) + b"".join(i.to_bytes(2, "big") for i in ids)).hex())
    elif a.what == "sound-send":
        chunks = [(i, data) for i, (_, data, _) in enumerate(read_folder(a.folder))]
        open(a.target, "wb").write(media.write_wav_float(M.chunks_to_sound(chunks, content_id(a.uri)), M.Modem().fs))
    elif a.what == "sound-receive":
        x, _ = media.read_wav_float(open(a.source, "rb").read())
        got = M.sound_to_chunks(x, content_id(a.uri) if a.uri else None)
        write_folder([(("recovery" if d[:4] == B.RECOVERY else "chunk") + f"_{k:04d}.bin", d, 0.0) for (_, k), d in got.items()], a.folder)
    elif a.what == "fix-wav":
        open(a.target, "wb").write(media.fix_wav(open(a.source, "rb").read(), a.rate))
    return 0


if __name__ == "__main__":
    sys.exit(main())
