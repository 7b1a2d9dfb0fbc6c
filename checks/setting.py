"""Parameters of the checks."""

from datetime import date

from clientela.params import Period

AS_OF = date(2001, 8, 1)
YEAR = Period(date(2000, 1, 1), date(2000, 12, 31))
MID_MONTH = Period(date(1999, 3, 10), date(2000, 9, 17))
LONG = Period(date(1995, 1, 15), date(2001, 8, 1))  # more months than one bit set holds
STORES = ["Online", "Store North", "Store South"]
CUSTOMER = 84
BIRTHDAY_RUN = date(2001, 7, 20)
LEAP_EVE = date(2001, 2, 21)  # seven days before 28 February of a year without a 29th
EVE = date(2000, 12, 28)  # seven days before a birthday in the next year
