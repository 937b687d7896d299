"""Digests, password hashes and ids. Password hashes, BLAKE3 and joaat are pandas UDFs."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col, val


def md5(s) -> Column:
    return F.md5(col(s).cast("binary"))


def sha1(s) -> Column:
    return F.sha1(col(s).cast("binary"))


def sha256(s) -> Column:
    return F.sha2(col(s).cast("binary"), 256)


def sha512(s) -> Column:
    return F.sha2(col(s).cast("binary"), 512)


def _udf(kind: str, f):
    """A pandas UDF of one or two columns that leaves NULL alone."""

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else f(x))

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=object)

    return lambda *xs: (one, two)[len(xs) - 1](*xs)


# fixed values of BLAKE3
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8


def _compress(chain, block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*chain, *_IV[:4], counter & 0xFFFFFFFF, counter >> 32, size, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_QUARTERS):
            for x, right, left in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & 0xFFFFFFFF
                t = v[d] ^ v[a]
                v[d] = (t >> right | t << (32 - right)) & 0xFFFFFFFF
                v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                t = v[b] ^ v[c]
                v[b] = (t >> left | t << (32 - left)) & 0xFFFFFFFF
        m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3_hex(data: bytes) -> str:
    """The 256-bit BLAKE3 digest."""

    def tree(start: int, chunks: int, root: int) -> list[int]:
        if chunks == 1:
            chunk = data[start * 1024 : (start + 1) * 1024]
            blocks = [chunk[i : i + 64] for i in range(0, len(chunk), 64)] or [b""]
            chain = list(_IV)
            for i, b in enumerate(blocks):
                last = i == len(blocks) - 1
                chain = _compress(chain, b.ljust(64, b"\0"), start, len(b), _START * (i == 0) | (_END | root) * last)
            return chain
        left = 1 << (chunks - 1).bit_length() - 1
        both = tree(start, left, 0) + tree(start + left, chunks - left, 0)
        return _compress(_IV, b"".join(x.to_bytes(4, "little") for x in both), 0, 64, _PARENT | root)

    return b"".join(x.to_bytes(4, "little") for x in tree(0, max(1, -(-len(data) // 1024)), _ROOT)).hex()


def joaat_value(data: bytes) -> int:
    """Jenkins' one-at-a-time hash."""
    h = 0
    for b in data:
        h = (h + b) & 0xFFFFFFFF
        h = (h + (h << 10)) & 0xFFFFFFFF
        h ^= h >> 6
    h = (h + (h << 3)) & 0xFFFFFFFF
    h ^= h >> 11
    return (h + (h << 15)) & 0xFFFFFFFF


def blake3(s) -> Column:
    return _udf("string", lambda x: blake3_hex(bytes(x)))(col(s).cast("binary"))


def joaat(s) -> Column:
    return _udf("bigint", lambda x: joaat_value(bytes(x)))(col(s).cast("binary"))


def _text(*parts: bytes | str) -> str:
    return "$" + "$".join(p if isinstance(p, str) else base64.b64encode(p).decode() for p in parts)


def _scrypt(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 12, r=8, p=1, dklen=32)


def _pbkdf2(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 20_000)


def _generate(name: str, derive):
    def make(password: str) -> str:
        salt = os.urandom(16)
        return _text(name, salt, derive(password, salt))

    return make


def _compare(name: str, derive):
    def same(stored: str, password: str) -> bool:
        parts = stored.split("$")
        if len(parts) != 4 or parts[1] != name:
            return False
        salt, digest = map(base64.b64decode, parts[2:])
        return hmac.compare_digest(digest, derive(password, salt))

    return same


def scrypt_generate(password) -> Column:
    return _udf("string", _generate("scrypt", _scrypt))(col(password))


def scrypt_compare(stored, password) -> Column:
    return _udf("boolean", _compare("scrypt", _scrypt))(col(stored), val(password))


def pbkdf2_generate(password) -> Column:
    return _udf("string", _generate("pbkdf2", _pbkdf2))(col(password))


def pbkdf2_compare(stored, password) -> Column:
    return _udf("boolean", _compare("pbkdf2", _pbkdf2))(col(stored), val(password))


def _needs(package: str):
    try:
        return __import__(package)
    except ImportError:
        raise NotImplementedError(f"needs the package {package}, which is not installed") from None


def argon2_generate(password) -> Column:
    hasher = _needs("argon2").PasswordHasher()
    return _udf("string", hasher.hash)(col(password))


def argon2_compare(stored, password) -> Column:
    package = _needs("argon2")

    def same(hashed: str, given: str) -> bool:
        try:
            return package.PasswordHasher().verify(hashed, given)
        except package.exceptions.VerifyMismatchError:
            return False

    return _udf("boolean", same)(col(stored), val(password))


def bcrypt_generate(password) -> Column:
    package = _needs("bcrypt")
    return _udf("string", lambda p: package.hashpw(p.encode(), package.gensalt()).decode())(col(password))


def bcrypt_compare(stored, password) -> Column:
    package = _needs("bcrypt")
    return _udf("boolean", lambda h, p: package.checkpw(p.encode(), h.encode()))(col(stored), val(password))


def uuid_v4() -> Column:
    return F.expr("uuid()")


def uuid_v7() -> Column:
    """Ordered by time of the query."""
    return F.expr("lower(concat(substr(lpad(hex(unix_millis(current_timestamp())), 12, '0'), 1, 8), '-', substr(lpad(hex(unix_millis(current_timestamp())), 12, '0'), 9, 4), '-7', substr(uuid(), 16, 3), '-', substr(uuid(), 20)))")
