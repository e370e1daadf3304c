"""SQL functions give what the Columns give."""

from lettermill.sql import register


def test_sql(spark):
    assert "mail_address" in register(spark)
    r = spark.sql("""SELECT mail_address('Bob <b@X.io>').address AS a, mail_address('junk') .address AS j, size(mail_address_list('a@b, c@d').parsed) AS n,
      mail_decode('=?utf-8?Q?=C3=BC?=') AS d, mail_unquote(mail_quote('a, b')) AS q, mail_ace_host('ü.io') AS h, size(mail_parse('Subject: x\n\nbody').parts) AS p""").first()
    assert tuple(r) == ("b@x.io", None, 2, "ü", "a, b", "xn--tda.io", 1)
