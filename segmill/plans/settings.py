"""Parameters of the registered queries, shared by both engines."""

AS_OF = "2024-02-01"
# The driver data has 25 brands and 6 types; smaller lists make the rest fold.
N_BRANDS = 23
N_CATEGORIES = 4

# Inclusive id range of the range read.
FIRST_ID, LAST_ID = 10, 99

# Half-open time range of the event table read.
RANGE_START, RANGE_END = "2024-01-05 12:00:00", "2024-01-27 06:00:00"

# Customers whose vectors are the centres of the single incremental step, and the centres' weights.
N_CENTRES = 4
CENTRE_WEIGHTS = [5.0, 3.0, 0.5, 1.0]

DENSITY_COLUMNS = ["total_spent", "avg_session_len_sec"]
EPS = 0.2
MIN_POINTS = 4
MIN_CLUSTER_SIZE = 4
# For the query in which hot cells are searched in slices.
HOT_MIN_POINTS = 8
HOT_SLICE_POINTS = 2

# Parts that the CSV rows are written in, those of a first batch and of a second one.
CSV_PARTS = (0, 1, 2, 3)
FIRST_PARTS = (0, 1)
LATER_PARTS = (1, 2, 3)
# Files that a part is dealt to at most where the copies of an event may be in any file.
STREAMED_FILES = 16
LATENESS = "10 days"
