"""Registered profile, review and session queries over whole tables."""

from pyspark.sql import functions as F

from courtside.operators import profiles as p
from courtside.operators import sessions as s
from courtside.plans.discovery_plans import FR, TR, TU, _r
from courtside.plans.registry import AS_OF, query

FACE = "u.first_name, u.last_name, u.profile_picture, u.img"


def _text(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


def _viewing_pairs(m, key):
    """(user, target) requests: everybody who booked or marked the target."""
    marked = {"facility_id": m.favorite_facility, "trainer_id": m.favorite_trainer}[key]
    return m.books.select("user_id", key).unionByName(marked.select("user_id", key)).distinct()


@query("r11_public_profile", "SELECT user_id, first_name, last_name, profile_picture, img, latitude, longitude, type, short_description FROM users")
def _(m):
    return p.public_profile(m.users)


@query("r12_upcoming_sessions", f"""
SELECT fs.user_id, fs.facility_sessions_id, fs.name, fs.description, f.latitude, f.longitude, fs.start_time, fs.end_time
FROM facility_sessions fs LEFT JOIN facilities f ON f.facility_id = fs.facility_id
WHERE fs.end_time > TIMESTAMP '{AS_OF}' AND fs.start_time > TIMESTAMP '{AS_OF}'""")
def _(m):
    return s.upcoming_sessions(m.facility_sessions, m.facilities, m.users, AS_OF)


@query("r13_appointments", f"""
WITH {FR}, ft AS (SELECT facility_sessions_id, min(trainer_id) AS trainer_id FROM trainer_sessions GROUP BY 1)
SELECT fs.facility_sessions_id, fs.user_id, fs.start_time, f.name, f.latitude, f.longitude, f.hourly_rate, coalesce(fr.ar, 0) AS avg_rating,
  CASE WHEN fs.start_time > TIMESTAMP '{AS_OF}' THEN 'upcoming' WHEN fs.start_time <= TIMESTAMP '{AS_OF}' AND fs.end_time >= TIMESTAMP '{AS_OF}' THEN 'ongoing' ELSE 'completed' END AS session_status,
  u.first_name, u.last_name, u.img, u.profile_picture
FROM facility_sessions fs LEFT JOIN facilities f ON f.facility_id = fs.facility_id LEFT JOIN fr ON fr.facility_id = f.facility_id
LEFT JOIN ft ON ft.facility_sessions_id = fs.facility_sessions_id LEFT JOIN trainers t ON t.trainer_id = ft.trainer_id
LEFT JOIN users u ON u.user_id = t.user_id""")
def _(m):
    return _r(s.appointments(m.facility_sessions, m.facilities, m.review_facility, m.trainer_sessions, m.trainers, m.users, m.users, AS_OF), "avg_rating")


@query("r14_trainer_profile", f"""
WITH v AS (SELECT user_id, trainer_id FROM books UNION SELECT user_id, trainer_id FROM favorite_trainer)
SELECT v.user_id, v.trainer_id, t.user_id AS trainer_user_id, {FACE}, u.type, u.latitude, u.longitude, u.short_description, t.hourly_rate,
  CASE WHEN ft.trainer_id IS NULL THEN 0 ELSE 1 END AS is_favorite
FROM v JOIN trainers t ON t.trainer_id = v.trainer_id JOIN users u ON u.user_id = t.user_id
LEFT JOIN favorite_trainer ft ON ft.trainer_id = v.trainer_id AND ft.user_id = v.user_id""")
def _(m):
    return p.trainer_profile(m.users, m.trainers, m.favorite_trainer, _viewing_pairs(m, "trainer_id"))


@query("r15_trainer_statistics", f"""
WITH {TR}, e AS (SELECT trainer_id, arg_min(datesub('year', start_date, end_date), experience_id) AS y FROM experiences GROUP BY 1)
SELECT t.trainer_id, coalesce(t.no_of_students, 0) AS no_of_students, coalesce(e.y, 0) AS years_of_experience,
  coalesce(tr.ar, 0) AS avg_rating, coalesce(tr.n, 0) AS no_of_reviews
FROM trainers t LEFT JOIN e ON e.trainer_id = t.trainer_id LEFT JOIN tr ON tr.trainer_id = t.trainer_id""")
def _(m):
    return _r(p.trainer_statistics(m.trainers, m.review_trainer, m.experiences), "avg_rating")


@query("r16_trainer_availability", "SELECT trainer_id, week_day, start_time, end_time, available FROM trainer_availability_hours")
def _(m):
    return p.availability(m.trainer_availability_hours, "trainer_id")


@query("r16_facility_availability", "SELECT facility_id, week_day, start_time, end_time, available FROM facility_availability_hours")
def _(m):
    return p.availability(m.facility_availability_hours, "facility_id")


@query("r17_trainer_reviews", f"""
WITH i AS (SELECT review_trainer_id, listagg(DISTINCT img, ',' ORDER BY img) AS imgs FROM review_trainer_img GROUP BY 1),
q AS (SELECT r.*, row_number() OVER (PARTITION BY trainer_id ORDER BY r.time DESC, review_trainer_id) AS rn FROM review_trainer r JOIN users USING (user_id))
SELECT q.trainer_id, u.user_id, u.img AS user_img, u.profile_picture, u.first_name, u.last_name, q.review_trainer_id, rating, q.time, content,
  coalesce(imgs, '') AS review_images
FROM q JOIN users u ON u.user_id = q.user_id LEFT JOIN i ON i.review_trainer_id = q.review_trainer_id WHERE rn <= 5""")
def _(m):
    return _text(p.trainer_reviews(m.users, m.review_trainer, m.review_trainer_img), "review_images")


def _phase(a, phase):
    now = f"TIMESTAMP '{AS_OF}'"
    return {"upcoming": f"{a}.start_time > {now} AND {a}.end_time > {now}", "ongoing": f"{a}.start_time <= {now} AND {a}.end_time > {now}",
            "completed": f"{a}.start_time < {now} AND {a}.end_time <= {now}"}[phase]


for _name in ("upcoming", "ongoing", "completed"):

    @query(f"r18_trainer_sessions_{_name}", f"""
WITH q AS (SELECT ts.trainer_id, fs.*, row_number() OVER (PARTITION BY ts.trainer_id ORDER BY fs.facility_sessions_id) AS rn
  FROM facility_sessions fs JOIN (SELECT DISTINCT trainer_id, facility_sessions_id FROM trainer_sessions) ts ON ts.facility_sessions_id = fs.facility_sessions_id WHERE {_phase('fs', _name)})
SELECT q.trainer_id, facility_sessions_id, f.name, q.description, f.latitude, f.longitude, q.start_time, q.end_time
FROM q LEFT JOIN facilities f ON f.facility_id = q.facility_id WHERE rn <= 10""")
    def _(m, phase=_name):
        return s.trainer_sessions(m.facility_sessions, m.trainer_sessions, m.facilities, phase, AS_OF)

    @query(f"r24_facilitator_sessions_{_name}", f"""
WITH q AS (SELECT fa.user_id AS owner, fs.facility_sessions_id, f.name, fs.description, f.latitude, f.longitude, fs.start_time, fs.end_time,
  row_number() OVER (PARTITION BY fa.user_id ORDER BY fs.facility_sessions_id) AS rn
  FROM facility_sessions fs JOIN facilities f ON f.facility_id = fs.facility_id JOIN facilitators fa ON fa.facilitator_id = f.facilitator_id WHERE {_phase('fs', _name)})
SELECT owner AS user_id, facility_sessions_id, name, description, latitude, longitude, start_time, end_time FROM q WHERE rn <= 10""")
    def _(m, phase=_name):
        return s.facilitator_sessions(m.facility_sessions, m.facilities, m.facilitators, phase, AS_OF)


@query("r19_trainer_monthly_sessions", """
SELECT ts.trainer_id, strftime(fs.start_time, '%Y-%m') AS month, count(DISTINCT ts.trainer_session_id) AS total_sessions
FROM facility_sessions fs JOIN trainer_sessions ts ON ts.facility_sessions_id = fs.facility_sessions_id GROUP BY 1, 2""")
def _(m):
    return s.trainer_monthly_sessions(m.facility_sessions, m.trainer_sessions)


@query("r20_trainer_profile_completion", """
SELECT trainer_id, round((6 + CASE WHEN EXISTS (SELECT 1 FROM certificates c WHERE c.trainer_id = t.trainer_id) THEN 1 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM educations c WHERE c.trainer_id = t.trainer_id) THEN 1 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM experiences c WHERE c.trainer_id = t.trainer_id) THEN 1 ELSE 0 END) / 9.0 * 100, 6) AS profile_completion FROM trainers t""")
def _(m):
    return _r(p.trainer_profile_completion(m.trainers, m.certificates, m.educations, m.experiences), "profile_completion")


@query("r21_trainer_info", "SELECT trainer_id, first_name, last_name, img, hourly_rate FROM trainers t LEFT JOIN users u ON u.user_id = t.user_id")
def _(m):
    return p.trainer_info(m.trainers, m.users)


@query("r22_trainer_credentials", """
SELECT trainer_id, 'experience' AS kind, experience_id AS item_id, designation AS title, company_name AS place, job_type AS detail, start_date, end_date FROM experiences
UNION ALL SELECT trainer_id, 'certificate', certificate_id, title, organization, NULL, start_date, end_date FROM certificates
UNION ALL SELECT trainer_id, 'education', education_id, course_name, institute_name, study_status, start_date, end_date FROM educations""")
def _(m):
    return p.trainer_credentials(m.experiences, m.certificates, m.educations)


@query("r22_trainer_credential_item", """
SELECT e.* FROM experiences e WHERE (trainer_id, experience_id) IN (SELECT trainer_id, trainer_id * 10 FROM trainers)""")
def _(m):
    req = m.trainers.select("trainer_id", (F.col("trainer_id") * 10).alias("experience_id"))
    return p.trainer_credential(m.experiences, "experience_id", req)


@query("r25_session_details", f"""
SELECT facility_sessions_id, fs.name, fs.description, fs.start_time, fs.end_time, f.latitude, f.longitude, {FACE}, u.type, u.phone
FROM facility_sessions fs LEFT JOIN users u ON u.user_id = fs.user_id LEFT JOIN facilities f ON f.facility_id = fs.facility_id""")
def _(m):
    return s.session_details(m.facility_sessions, m.users, m.facilities)


@query("r26_session_trainer", """
SELECT facility_sessions_id, ts.trainer_id, first_name, last_name, type, phone FROM trainer_sessions ts
JOIN trainers t ON t.trainer_id = ts.trainer_id JOIN users u ON u.user_id = t.user_id""")
def _(m):
    return s.session_trainer(m.trainer_sessions, m.trainers, m.users)


@query("r27_facilitator_summary", """
SELECT f.facilitator_id, user_id, min(fa.established_in) AS established_in, no_of_professionals, iso_certified
FROM facilitators f JOIN facilities fa ON fa.facilitator_id = f.facilitator_id GROUP BY ALL""")
def _(m):
    return p.facilitator_summary(m.facilitators, m.facilities)


@query("r28_facilitator_profile_completion", """
SELECT facilitator_id, f.user_id, round(100 - (CASE WHEN coalesce(first_name, '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(last_name, '') = '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(profile_picture, '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(img, '') = '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(latitude, 0) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(longitude, 0) = 0 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(no_of_professionals, 0) = 0 THEN 1 ELSE 0 END) / 6.0 * 100, 2) AS profile_completion
FROM facilitators f JOIN users u ON u.user_id = f.user_id""")
def _(m):
    return p.facilitator_profile_completion(m.users, m.facilitators)


@query("r29_facility_list", """
SELECT facilitator_id, facility_id, name FROM (SELECT *, row_number() OVER (PARTITION BY facilitator_id ORDER BY facility_id) AS rn FROM facilities) WHERE rn <= 5""")
def _(m):
    return p.facility_list(m.facilities)


@query("r29_facility_list_page_2", """
SELECT facilitator_id, facility_id, name FROM (SELECT *, row_number() OVER (PARTITION BY facilitator_id ORDER BY facility_id) AS rn FROM facilities) WHERE rn > 5 AND rn <= 10""")
def _(m):
    return p.facility_list(m.facilities, page=2)


@query("r30_facilitator_reviews", f"""
WITH i AS (SELECT review_facilitator_id, listagg(DISTINCT img, ',' ORDER BY img) AS imgs FROM review_facilitator_img GROUP BY 1),
q AS (SELECT *, row_number() OVER (PARTITION BY facilitator_id ORDER BY time DESC, review_facilitator_id) AS rn FROM review_facilitators)
SELECT q.facilitator_id, q.review_facilitator_id, {FACE}, rating, content, q.time, coalesce(imgs, '') AS images
FROM q LEFT JOIN users u ON u.user_id = q.user_id LEFT JOIN i ON i.review_facilitator_id = q.review_facilitator_id WHERE rn <= 5""")
def _(m):
    return _text(p.facilitator_reviews(m.review_facilitators, m.users, m.review_facilitator_img), "images")


@query("r31_facility_basic", """
WITH owners AS (SELECT f.facility_id, fa.user_id FROM facilities f JOIN facilitators fa ON fa.facilitator_id = f.facilitator_id),
req AS (SELECT user_id, facility_id FROM books UNION SELECT user_id, facility_id FROM owners)
SELECT req.user_id, f.facility_id, name, hourly_rate, description, latitude, longitude, capacity
FROM req JOIN owners o ON o.user_id = req.user_id AND o.facility_id = req.facility_id JOIN facilities f ON f.facility_id = req.facility_id""")
def _(m):
    owners = m.facilities.join(m.facilitators, "facilitator_id").select("user_id", "facility_id")
    return p.facility_basic(m.facilities, m.facilitators, m.books.select("user_id", "facility_id").unionByName(owners))


@query("r32_facility_gallery", """
SELECT facility_id, facility_img_id, img FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY facility_img_id) AS rn FROM facility_img) WHERE rn <= 5""")
def _(m):
    return p.facility_gallery(m.facility_img)


@query("r32_facility_images", "SELECT DISTINCT facility_id, img FROM facility_img")
def _(m):
    return p.facility_images(m.facility_img)


@query("r33_facility_reviews", f"""
WITH {FR}, i AS (SELECT review_facility_id, listagg(DISTINCT img, ',' ORDER BY img) AS imgs FROM review_facility_img GROUP BY 1),
q AS (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY time DESC, review_facility_id) AS rn FROM review_facility)
SELECT q.facility_id, q.review_facility_id, {FACE}, rating, q.time, content, coalesce(imgs, '') AS images, fr.n AS no_of_reviews
FROM q JOIN fr ON fr.facility_id = q.facility_id LEFT JOIN users u ON u.user_id = q.user_id LEFT JOIN i ON i.review_facility_id = q.review_facility_id WHERE rn <= 10""")
def _(m):
    return _text(p.facility_reviews(m.review_facility, m.users, m.review_facility_img), "images")


@query("r34_facilitator_details", """
SELECT facilitator_id, first_name, last_name, no_of_professionals, latitude, longitude FROM facilitators f LEFT JOIN users u ON u.user_id = f.user_id""")
def _(m):
    return p.facilitator_details(m.facilitators, m.users)


@query("r36_facilitator_employees", f"""
SELECT e.facilitator_id, t.trainer_id, {FACE} FROM facilitator_employees e LEFT JOIN trainers t ON t.trainer_id = e.trainer_id LEFT JOIN users u ON u.user_id = t.user_id""")
def _(m):
    return p.facilitator_employees(m.facilitator_employees, m.trainers, m.users)


@query("r37_facility_details", f"""
WITH {FR}, v AS (SELECT user_id, facility_id FROM books UNION SELECT user_id, facility_id FROM favorite_facility),
a AS (SELECT facility_id, listagg(DISTINCT name, ',' ORDER BY name) AS names FROM amenities GROUP BY 1)
SELECT v.user_id, f.facility_id, f.name, f.description, f.hourly_rate, f.latitude, f.longitude, fa.user_id AS owner_user_id, {FACE}, u.phone,
  CASE WHEN ff.facility_id IS NULL THEN 0 ELSE 1 END AS is_favorite, coalesce(fr.n, 0) AS no_of_reviews, coalesce(fr.ar, 0) AS avg_rating, coalesce(a.names, '') AS amenities
FROM v JOIN facilities f ON f.facility_id = v.facility_id LEFT JOIN facilitators fa ON fa.facilitator_id = f.facilitator_id
LEFT JOIN users u ON u.user_id = fa.user_id LEFT JOIN fr ON fr.facility_id = f.facility_id LEFT JOIN a ON a.facility_id = f.facility_id
LEFT JOIN favorite_facility ff ON ff.facility_id = v.facility_id AND ff.user_id = v.user_id""")
def _(m):
    df = p.facility_details(m.facilities, m.facilitators, m.users, m.review_facility, m.amenities, m.favorite_facility, _viewing_pairs(m, "facility_id"))
    return _text(_r(df, "avg_rating"), "amenities")


@query("r38_facility_employees", f"""
WITH {TR}, {TU}
SELECT e.facility_id, e.trainer_id, first_name, last_name, profile_picture, img, coalesce(tr.n, 0) AS no_of_reviews, coalesce(tr.ar, 0) AS avg_rating
FROM facility_employees e LEFT JOIN i ON i.trainer_id = e.trainer_id LEFT JOIN tr ON tr.trainer_id = e.trainer_id""")
def _(m):
    return _r(p.facility_employees(m.facility_employees, m.trainers, m.users, m.review_trainer), "avg_rating")


@query("r51_children_of", """
SELECT p.user_id, c.parent_id, c.child_id, c.name, c.age, c.gender, c.sport_interest, c.sport_level FROM parents p JOIN children c ON c.parent_id = p.parent_id""")
def _(m):
    # every user asks for the parent id equal to their own id and for its neighbour: only owners are served
    own = m.users.select("user_id", F.col("user_id").alias("parent_id"))
    other = m.users.select("user_id", (F.col("user_id") + 5).alias("parent_id"))
    return p.children_of(m.parents, m.children, own.unionByName(other))


@query("r51_child_of", """
SELECT p.user_id, c.parent_id, c.child_id, c.name, c.age, c.gender, c.sport_interest, c.sport_level FROM parents p JOIN children c ON c.parent_id = p.parent_id
WHERE c.child_id = p.parent_id * 10 + 1""")
def _(m):
    req = m.users.select("user_id", F.col("user_id").alias("parent_id"), (F.col("user_id") * 10 + 1).alias("child_id"))
    return p.children_of(m.parents, m.children, req)


@query("r52_specialized_user", """
SELECT u.user_id, coalesce(nullif(f.facilitator_id, 0), nullif(t.trainer_id, 0), nullif(a.athlete_id, 0), nullif(p.parent_id, 0)) AS specialized_user_id
FROM users u LEFT JOIN facilitators f ON f.user_id = u.user_id LEFT JOIN trainers t ON t.user_id = u.user_id
LEFT JOIN athletes a ON a.user_id = u.user_id LEFT JOIN parents p ON p.user_id = u.user_id""")
def _(m):
    return p.specialized_user(m.users, m.facilitators, m.trainers, m.athletes, m.parents)
