"""Functions beyond Spark's own, all as Catalyst expressions."""

from .compat import date_bin, digest, gcd, groups_frame_rank, lcm, round_toward_zero
from .url import register, url_path_hash

__all__ = ["date_bin", "digest", "gcd", "groups_frame_rank", "lcm", "register", "round_toward_zero", "url_path_hash"]
