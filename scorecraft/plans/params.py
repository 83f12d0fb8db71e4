"""Default report parameters used by the registered queries and the bench.

The reference takes these as macro variables; here they are typed function
arguments with these defaults (a multi-year window over the test data).
"""

import datetime as dt

PERIOD_START = dt.date(1996, 1, 1)
PERIOD_END = dt.date(2000, 12, 31)
BEST_PRICE_SINCE = dt.date(1996, 1, 1)
ASOF = dt.date(2000, 6, 15)
SALES_VENDOR = 7
HOUSE_VENDOR = 7
LARGE_THRESHOLD = 100000
