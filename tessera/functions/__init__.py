from tessera.functions.hashing import hkey, hash_hex, uniform, pick
from tessera.functions.exprs import clip, nan_to_default, safe_ratio, count_substring

__all__ = ["hkey", "hash_hex", "uniform", "pick", "clip", "nan_to_default",
           "safe_ratio", "count_substring"]
