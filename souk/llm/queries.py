"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from souk.llm.bagminhash import op6_bagminhash
from souk.llm.collocations import OP12_SQL, op12_collocations
from souk.llm.conversations import OP11_SQL, op11_conversations
from souk.llm.decontam import OP7_SQL, op7_decontam
from souk.llm.huffman import op10_huffman
from souk.llm.lines import op9_lines
from souk.llm.oracles import OP1_SQL, OP3_SQL, OP4_SQL, OP6_SQL, OP9_SQL
from souk.llm.packing import op8_packing
from souk.llm.pieces import op13_pieces
from souk.llm.quality import op1_quality
from souk.llm.sharding import op5_sharding
from souk.llm.substring import op4_substring
from souk.llm.toxicity import op2_toxicity
from souk.llm.warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_warc, op4_substring, op5_sharding, op6_bagminhash, op7_decontam, op8_packing, op9_lines, op10_huffman, op11_conversations, op12_collocations, op13_pieces)}
ORACLES = {"op1_quality": OP1_SQL, "op3_warc": OP3_SQL, "op4_substring": OP4_SQL, "op6_bagminhash": OP6_SQL, "op7_decontam": OP7_SQL, "op9_lines": OP9_SQL, "op11_conversations": OP11_SQL, "op12_collocations": OP12_SQL}
