"""Small tables that the tests share."""

STUDENTS = [(1, "joe", 10, 2021), (2, "amy", 20, 2020), (3, "max", 10, 2022), (4, "sue", 20, 2022), (5, "bob", 30, 2020), (6, "kim", 20, 2020), (7, "art", 30, 2021), (8, "pat", 20, 2019), (9, "lee", 10, 2021)]
DEPARTMENTS = [(10, "compsci"), (20, "math"), (30, "drama")]
ENROLLED = [(14, 1, 13, "A"), (24, 1, 43, "C"), (34, 2, 43, "B+"), (44, 4, 33, "B"), (54, 4, 53, "A"), (64, 6, 53, "A")]


def fill(engine):
    with engine.begin() as tx:
        tx.execute("create table student (sid int, sname varchar(10), majorid int, gradyear int)")
        tx.execute("create table dept (did int, dname varchar(8))")
        tx.execute("create table enroll (eid int, studentid int, sectionid int, grade varchar(2))")
        tx.execute("create index idx on enroll (studentid)")
        for s in STUDENTS:
            tx.execute("insert into student (sid, sname, majorid, gradyear) values ({}, '{}', {}, {})".format(*s))
        for d in DEPARTMENTS:
            tx.execute("insert into dept (did, dname) values ({}, '{}')".format(*d))
        for e in ENROLLED:
            tx.execute("insert into enroll (eid, studentid, sectionid, grade) values ({}, {}, {}, '{}')".format(*e))
    return engine


def rows(df):
    return sorted(tuple(r) for r in df.collect())
