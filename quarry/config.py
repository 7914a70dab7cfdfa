"""Default parameters.

Fixed values that must equal the original pipeline's for the same results:
BM25 k1 = 1.2, b = 0.75, idf floor factor 0.25; TF-IDF vocabulary of the
5000 most frequent n-grams, n-gram range (1, 2); Recall cut-offs 1, 5, 10, 20;
nDCG cut-off 10; training batch size 16; temporal split: train before 2017,
validation 2017-2018, test 2019-2021.
"""

BM25_K1 = 1.2
BM25_B = 0.75
BM25_EPSILON = 0.25

TFIDF_VOCAB_SIZE = 5000
TFIDF_NGRAM_RANGE = (1, 2)

EVAL_K_VALUES = (1, 5, 10, 20)
NDCG_K = 10

TRAIN_BATCH_SIZE = 16

TRAIN_BEFORE_YEAR = 2017
VAL_YEARS = (2017, 2018)
TEST_YEARS = (2019, 2020, 2021)

# Ranking convention (the original leaves tie order unspecified): scores are
# compared at float32 precision, then by ascending doc id.

# Bytes up to which a side that may grow with the data is broadcast.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# Joined rows per task from which a term's postings are spread over tasks, and
# how many terms may be (the bound on rows rises with the input instead).
ROWS_PER_SALT = 4_000_000
MAX_HOT_TERMS = 100_000

# Cells of one product tile of a dense kernel (8 bytes each).
TILE_CELLS = 4_000_000
