import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clickpath.runtime import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    yield session
    session.stop()


EVENT_DDL = ("guid long, sec long, event_id long, is_click int, domain string, keywords array<string>, "
             "year int, month int, day int")


@pytest.fixture(scope="session")
def events(spark):
    """Build event rows from (guid, sec, domain) and optional fields."""

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            guid, sec, domain, *rest = row
            words = rest[0] if rest else [domain]
            day = rest[1] if len(rest) > 1 else 1 + sec // 86400
            full.append((guid, sec, i, int(domain.startswith("m")), domain, words, 2024, 1, day))
        return spark.createDataFrame(full, EVENT_DDL)

    return build


STEP_DDL = "guid long, session_no long, pos int, domain string"


@pytest.fixture(scope="session")
def visits(spark):
    """Flat session rows from {session_no: 'a b c'}, all of one user."""

    def build(sessions, guid=1):
        rows = [(guid, no, pos, domain) for no, text in sessions.items()
                for pos, domain in enumerate(text.split())]
        return spark.createDataFrame(rows, STEP_DDL)

    return build
