"""The queries of this package and their DuckDB twins."""

from .chat import OP13_SQL, op13_chat
from .langid import op9_langid
from .linededup import OP10_SQL, op10_linededup
from .maxscore import OP6_SQL, op6_maxscore
from .merkle import OP12_SQL, op12_merkle
from .mixing import op2_mixing
from .ngramjoin import op5_ngramjoin
from .packing import op8_packing
from .quality import op4_quality
from .resample import OP11_SQL, op11_resample
from .sharding import op1_sharding
from .substring import op3_substring
from .winnowing import op7_winnowing

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_quality": op4_quality,
    "op5_ngramjoin": op5_ngramjoin,
    "op6_maxscore": op6_maxscore,
    "op7_winnowing": op7_winnowing,
    "op8_packing": op8_packing,
    "op9_langid": op9_langid,
    "op10_linededup": op10_linededup,
    "op11_resample": op11_resample,
    "op12_merkle": op12_merkle,
    "op13_chat": op13_chat,
}
ORACLES = {"op6_maxscore": OP6_SQL, "op10_linededup": OP10_SQL, "op11_resample": OP11_SQL, "op12_merkle": OP12_SQL, "op13_chat": OP13_SQL}
