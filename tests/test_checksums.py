import random
import zlib

from blockledger.functions.checksums import chunk_crcs, combined
from blockledger.operators.payload import backup_payload, checksum_meta, verify_payload, whole_sums

HELD = "pool_id string, block_id bigint, length bigint, gen_stamp bigint, data binary"


def crc32c(data):
    """Bit by bit."""
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_known_sums():
    assert crc32c(b"123456789") == 0xE3069283
    assert chunk_crcs([b"123456789"], 512, "crc32c") == [[0xE3069283]] and chunk_crcs([b"123456789"], 512, "crc32") == [[0xCBF43926]]


def test_chunks_and_wholes():
    draw = random.Random(1)
    texts = [draw.randbytes(n) for n in (0, 1, 15, 16, 17, 32, 33, 100, 1000, 4097)] + [None]
    for size in (1, 16, 512):
        for kind, of in (("crc32", zlib.crc32), ("crc32c", crc32c)):
            sums = chunk_crcs(texts, size, kind)
            assert sums == [None if t is None else [of(t[i : i + size]) for i in range(0, len(t), size)] for t in texts]
            assert all(combined(s, len(t), size, kind) == of(t) for s, t in zip(sums, texts) if t is not None)
    assert chunk_crcs([], 16, "crc32c") == [] == chunk_crcs([None, b""], 16, "crc32c")[1]


def test_blocks(table, blocks):
    data = [b"", b"a", b"x" * 512, bytes(range(256)) * 5]
    held = table([("p", i, len(d), 1, d) for i, d in enumerate(data)] + [("p", 9, 4, 1, None)], HELD)
    meta = checksum_meta(held, 512, "crc32c")
    got = {r["block_id"]: (r["meta"], r["algorithm"]) for r in meta.collect()}
    assert got == {**{i: ([crc32c(d[k : k + 512]) for k in range(0, len(d), 512)], "crc32c") for i, d in enumerate(data)}, 9: (None, "crc32c")}
    assert {r["block_id"]: r["checksum"] for r in whole_sums(meta, 512, "crc32c").collect()} == {**dict(enumerate(map(crc32c, data))), 9: None}
    copied = backup_payload(held.filter("block_id < 9"), held, algorithm="crc32c").drop("status")
    assert {r["fault"] for r in verify_payload(copied, algorithm="crc32c").collect()} == {"none"}
    assert {r["fault"] for r in verify_payload(copied.filter("length > 0"), algorithm="crc32").collect()} == {"checksum"}
