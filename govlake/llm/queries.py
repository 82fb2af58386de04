"""Queries of this subpackage, and the SQL that gives the same rows where SQL can express it."""

from govlake.llm import op1_lines as lines
from govlake.llm import op3_warc as warc
from govlake.llm import op8_benchmark as benchmark
from govlake.llm import op11_resampling as resampling
from govlake.llm import op12_divergence as divergence
from govlake.llm.op1_lines import op1_lines
from govlake.llm.op2_sentencepiece import op2_sentencepiece
from govlake.llm.op3_warc import op3_warc
from govlake.llm.op4_quality_rules import op4_quality_rules
from govlake.llm.op5_token_counts import op5_token_counts
from govlake.llm.op6_minhash import op6_minhash
from govlake.llm.op7_repair import op7_repair
from govlake.llm.op8_benchmark import op8_benchmark
from govlake.llm.op9_cotraining import op9_cotraining
from govlake.llm.op10_substrings import op10_substrings
from govlake.llm.op11_resampling import op11_resampling
from govlake.llm.op12_divergence import op12_divergence
from govlake.llm.op13_transducer import op13_transducer

QUERIES = {f.__name__: f for f in (op1_lines, op2_sentencepiece, op3_warc, op4_quality_rules, op5_token_counts, op6_minhash, op7_repair, op8_benchmark, op9_cotraining, op10_substrings, op11_resampling, op12_divergence, op13_transducer)}
ORACLE_SQL = {"op1_lines": lines.SQL, "op3_warc": warc.SQL, "op8_benchmark": benchmark.SQL, "op11_resampling": resampling.SQL, "op12_divergence": divergence.SQL}
