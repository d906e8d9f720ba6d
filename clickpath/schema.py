"""Column names of the data model, in one place.

Event rows carry ``guid, sec, event_id, is_click, domain, keywords, year,
month, day``; ``sec`` is whole seconds since the epoch. A session is the rows
sharing (guid, session_no), a step is one row of a session.
"""

USER = "guid"
TIME = "sec"
DOMAIN = "domain"
EVENT = ["guid", "sec", "event_id", "is_click", "domain", "keywords", "year", "month", "day"]
# order inside a user: by time, impressions before clicks, then by event id
ORDER = ["sec", "is_click", "event_id"]
SESSION = ["guid", "session_no"]
RUN = ["guid", "session_no", "run_no"]
STEP = ["guid", "session_no", "pos"]
