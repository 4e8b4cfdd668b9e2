import datetime as dt

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 6, 1)
