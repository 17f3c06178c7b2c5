"""spark-submit entry for the clean-once workflow (ship the package with
--py-files, e.g. a zip of ledgerwash/):

    spark-submit --py-files ledgerwash.zip tools/submit_workflow.py \
        --transactions RAW_TX --customers RAW_CUST --out OUT --format csv
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerwash.__main__ import main  # noqa: E402

if __name__ == "__main__":
    main()
