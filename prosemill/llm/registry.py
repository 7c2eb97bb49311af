"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from .embedding_dedup import op1_embedding_dedup
from .language_id import op9_language_id
from .lm_scoring import OP4_SQL, op4_lm_scoring
from .minhash_dedup import op10_minhash_dedup
from .mixing import op8_mixing
from .packing import op6_packing
from .quality_rules import OP5_SQL, op5_quality_rules
from .secret_scan import OP7_SQL, op7_secret_scan
from .sharding import OP3_SQL, op3_sharding
from .token_counts import op2_token_counts

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_token_counts, op3_sharding, op4_lm_scoring, op5_quality_rules, op6_packing, op7_secret_scan, op8_mixing, op9_language_id, op10_minhash_dedup)}
ORACLE: dict[str, str] = {"op3_sharding": OP3_SQL, "op4_lm_scoring": OP4_SQL, "op5_quality_rules": OP5_SQL, "op7_secret_scan": OP7_SQL}
